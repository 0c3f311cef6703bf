"""Quality rules learned as a decision list over native text statistics.

Every statistic is a Spark expression. Labelled statistics are cut at their quantiles, counted
per combination in Spark, and sequential covering grows a conjunction of thresholds on two thirds
of the labelled rows, prunes it on the rest, and goes on with the rows it does not cover. The list
becomes one ordered ``CASE`` expression; a row that no rule covers is kept.

Null texts have no words and fail the base rule. Equal rows are judged alike. Without labels the
list is empty and only the base rule rejects. Columns other than the key and the text are ignored.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import require, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: The labelled rows a list is learned from at most, and the quantiles at which statistics are cut.
MAX_LABELLED, CUTS = 20_000, 24
#: What a rule needs on the rows it was not grown on, and the most conditions and rules.
PRECISION, LEAST_ROWS, MOST_CONDITIONS, MOST_RULES = 0.97, 5, 3, 12

#: The learned statistics by name.
STATISTICS = {
    "symbols_per_word": "n_symbols / n_words",
    "mean_word_chars": "word_chars / n_words",
    "repeat_share": "n_repeat_words / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "capitals_share": "n_capitals / word_chars",
    "marks_per_word": "n_marks / n_words",
    "distinct_share": "n_distinct / n_words",
    "words_per_line": "n_words / n_lines",
}


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value > self.threshold if self.above else value <= self.threshold


def repeat_words(words: str, grams: str) -> Column:
    """Words inside windows of eight that occur twice or more, the first occurrence included."""
    by_hash = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, i: (x["h"] == F.get(ordered, i + 1)["h"]) | (x["h"] == F.get(ordered, i - 1)["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def length(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.get(starts, i + 1) - p))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    # One-element arrays stand for local names, so that nothing is sorted twice.
    starts = F.transform(F.array(by_hash), covered)
    total = F.get(F.transform(starts, length), F.lit(0))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), total).otherwise(0).cast("long")


def base_statistics(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, as a struct ``row``, with the counts that the base rule and the learned list use."""
    require(documents, (key, text))
    whole = documents.select(F.struct(*documents.columns).alias("row"), text_or_empty(text).alias("whole"))
    cut = whole.select("row", "whole", F.array_remove(F.split("whole", SPACE), "").alias("words"), F.filter(F.split("whole", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("words")
    windows = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    grams = cut.withColumn("grams", windows)
    occurrences = lambda pattern: F.size(F.split("whole", pattern, -1)) - 1
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": occurrences(SYMBOLS),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeat_words("words", "grams"),
        "n_lines": F.size("lines"),
        "n_capitals": occurrences(r"\p{Lu}"),
        "n_marks": occurrences("[!?]"),
        "n_distinct": F.size(F.array_distinct("words")),
    }
    return grams.select("row", *(once(c.cast("long")).alias(name) for name, c in counts.items()))


def once(column: Column) -> Column:
    """``column``, kept where it is: a filter on it is not moved below, which would compute it anew."""
    return F.when(F.spark_partition_id() >= 0, column)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def learned_statistics(counts: DataFrame) -> DataFrame:
    """``counts`` with the ratios of ``STATISTICS``; 0 where nothing can be divided by."""
    return counts.withColumns({name: F.coalesce(F.try_divide(*(F.col(c).cast("double") for c in ratio.split(" / "))), F.lit(0.0)) for name, ratio in STATISTICS.items()})


def bin_number(statistic: str, edges: list[float]) -> Column:
    """How many of the sorted edges a statistic exceeds."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(statistic)))


def learn(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> list[tuple[Condition, ...]]:
    """Rules that reject, in order, from at most ``MAX_LABELLED`` labelled rows (those of smallest key hash)."""
    require(labels, (key, label))
    drawn = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("good")).orderBy(F.xxhash64(key), key).limit(MAX_LABELLED)
    # The drawn labels are bounded by MAX_LABELLED rows of two numbers.
    rows = documents.select(key, text).join(F.broadcast(drawn), key).select(key, text, "good")
    usable = learned_statistics(base_statistics(rows, key, text)).filter(~base_failed())
    stats = usable.select(F.col("row")[key].alias(key), F.col("row")["good"].alias("good"), *STATISTICS).persist()
    try:
        at = [i / CUTS for i in range(1, CUTS)]
        quantiles = stats.groupBy("good").agg(*(F.percentile_approx(s, at, 10_000).alias(s) for s in STATISTICS)).collect()
        edges = {s: sorted({e for row in quantiles for e in row[s]}) for s in STATISTICS}
        # Halfway between quantiles, so that no threshold lies on a value that many rows have.
        cuts = {s: [(a + b) / 2 for a, b in itertools.pairwise(e)] for s, e in edges.items() if len(e) > 1}
        if not cuts:
            return []
        bin_of = {s: bin_number(s, edges) for s, edges in cuts.items()}
        held = F.pmod(F.xxhash64(F.lit("prune"), key), F.lit(3)) == 0
        cells = stats.groupBy(*(c.alias(s) for s, c in bin_of.items()), held.alias("held"), "good").count().collect()
    finally:
        stats.unpersist()
    table = [({s: row[s] for s in cuts}, bool(row["held"]), row["good"] == 0, row["count"]) for row in cells]
    return [tuple(Condition(s, above, float(cuts[s][b])) for s, above, b in rule) for rule in sequential_covering(table)]


Cell = tuple[dict[str, int], bool, bool, int]
Test = tuple[str, bool, int]


def _meets(bins: dict[str, int], rule: list[Test]) -> bool:
    return all((bins[s] > b) == above for s, above, b in rule)


def _tally(cells: list[Cell], rule: list[Test]) -> tuple[int, int]:
    """Bad and good rows that a rule covers."""
    bad = good = 0
    for bins, _, is_bad, n in cells:
        if _meets(bins, rule):
            bad, good = (bad + n, good) if is_bad else (bad, good + n)
    return bad, good


def _grow(cells: list[Cell]) -> list[Test]:
    """Adds the condition of the highest information gain until no good row is covered."""
    rule: list[Test] = []
    while len(rule) < MOST_CONDITIONS:
        inside = [c for c in cells if _meets(c[0], rule)]
        bad, good = _tally(inside, [])
        if not bad or not good:
            break
        before, best = math.log2(bad / (bad + good)), (1e-9, None)
        for s in inside[0][0]:
            by_bin: dict[int, list[int]] = {}
            for bins, _, is_bad, n in inside:
                by_bin.setdefault(bins[s], [0, 0])[0 if is_bad else 1] += n
            b = g = 0
            for edge in sorted(by_bin)[:-1]:
                b, g = b + by_bin[edge][0], g + by_bin[edge][1]
                for above, x, y in ((False, b, g), (True, bad - b, good - g)):
                    if x and (gain := x * (math.log2(x / (x + y)) - before)) > best[0]:
                        best = (gain, (s, above, edge))
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def _prune(rule: list[Test], cells: list[Cell]) -> list[Test]:
    """The shortest beginning of a rule that is best on rows it was not grown on."""
    def worth(r: list[Test]) -> float:
        bad, good = _tally(cells, r)
        return (bad - good) / (bad + good) if bad + good else -1

    return max((rule[:n] for n in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=[])


def sequential_covering(cells: list[Cell]) -> list[list[Test]]:
    """Ordered conjunctions that cover bad rows; each is grown, pruned and then taken out."""
    left, rules = cells, []
    while len(rules) < MOST_RULES:
        grown = _grow([c for c in left if not c[1]])
        rule = _prune(grown, [c for c in left if c[1]])
        if not rule:
            break
        bad, good = _tally(left, rule)
        held_bad, held_good = _tally([c for c in left if c[1]], rule)
        if bad < LEAST_ROWS or bad < PRECISION * (bad + good) or held_bad < PRECISION * (held_bad + held_good):
            break
        rules.append(rule)
        left = [c for c in left if not _meets(c[0], rule)]
    return rules


def verdict(rules: list[tuple[Condition, ...]]) -> Column:
    """The number of the first rule that rejects a row, null for a kept one."""
    out = F.lit(None).cast("int")
    for number, rule in reversed([*enumerate(rules, 1)]):
        met = rule[0].column()
        for condition in rule[1:]:
            met = met & condition.column()
        out = F.when(met, number).otherwise(out)
    return out


def ruled(documents: DataFrame, rules: list[tuple[Condition, ...]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, as a struct ``row``, with their counts, base_failed, rule (the first that rejects) and kept."""
    counts = learned_statistics(base_statistics(documents, key, text)).withColumn("base_failed", base_failed())
    found = counts.withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
    return found.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def judge(documents: DataFrame, rules: list[tuple[Condition, ...]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, the base counts, base_failed, rule and kept."""
    return ruled(documents, rules, key, text).select(F.col("row")[key].alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


def keep(documents: DataFrame, rules: list[tuple[Condition, ...]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that are kept, with their own columns."""
    return ruled(documents, rules, key, text).filter("kept").select("row.*")
