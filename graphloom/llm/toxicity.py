"""Toxicity scores from a learned lexicon, misspellings included.

Spark counts in how many toxic and clean labelled texts a word occurs; those more toxic than chance
allows are the lexicon. Near copies of a text would repeat its words, so of texts that share a minimum
hash only one counts. Every word of a text is read by a Levenshtein automaton intersected with the
lexicon's trie: its states are sets of places in the trie with the edits it took to come there. States
are made as words need them and kept, so most words end at a known dead state after a few letters.

What a hit is worth is measured on the labelled rows for each entry, and for words one and two edits away
from it apart: the odds of a text that holds it, and how much more often it stands in toxic than in clean
texts. The strongest hit counts, or, where that is more, how dense all hits are by the latter measure: an
entry or its misspellings may stand in clean texts as well, but not many together. A hit inside
quotation marks, or close to a verb of saying and a colon, weighs less than an open one; other hits
around it add to it.

Null and empty texts get the score of texts without a hit. Labels other than 0 and 1 are left out; a row
with both counts as toxic. Without labels the lexicon is empty and all scores are low; ties among entries
go by alphabet. Only texts are scored: no other column is read, save the key, which decides what is held
out, and columns may have any further names. A text is held by one task, however long. An empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, require, stored, text_or_empty

#: The most lexicon entries, and what an entry's toxic share and surprise (nats) must be.
MOST_ENTRIES, SHARE, SURPRISE = 20_000, 0.4, 0.0
#: Words of a shingle, and the orders in which its hashes have a minimum.
SHINGLE, ORDERS = 5, (0, 0x5DEECE66D1CE4E5B, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85)
#: Words to each side of a hit that are its context, and what a quoted hit's evidence is multiplied by.
CONTEXT, QUOTED = 5, 0.3
CACHE_WORDS = 400_000
#: States of the automaton that are kept; with more, it starts anew.
MOST_STATES = 100_000
KINDS = ("word", "one edit", "two edits")
#: What is believed of a hit of each kind before any was seen, as a share of the entry's own toxic share; how
#: many texts an entry must have for it to be believed half; by how many deviations a share is taken lower.
BELIEF, DOUBT, CAUTION = (1.0, 0.97, 0.93), (0, 2, 3), 2.5
#: Densities by powers of two; a text's first hit alone is none.
DENSITIES = 10
# Digits and signs that stand for letters, quotation marks, verbs of saying.
LEET = str.maketrans("01345@$", "oieasas")
OPENING, CLOSING, EITHER = "“„«‹「", "”»›」", "\""
SAYING = frozenset("said says say quoted quotes quote wrote writes called calls reads replied sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())


_INNER = re.compile(r"[\W\d_]+")


def normal_word(word: str) -> str:
    """A word in lower case without marks around or in it, letters for digits that stand for them."""
    word = word.lower()
    if word.isalpha():
        return word
    word = word.strip(".,;:!?()[]{}'\"“”„«»‹›")
    if not word.isalpha() and any(c.isalpha() for c in word):
        word = re.sub(r"[\W_]+", "", word.translate(LEET))
    return word


@dataclass
class Lexicon:
    """Entries with their toxic share, the texts they were seen in, and what was learned of the hits.

    ``weights`` has the log odds of a text with a hit of each kind on each entry, ``rates`` how much more
    often such hits stand in toxic texts than in clean ones (a logarithm, 0 at least), ``dense`` the
    log odds by density, and ``base`` the toxic share of texts without a hit.
    """

    words: dict[str, tuple[float, int]]
    weights: dict[tuple[str, str], float] = field(default_factory=dict)
    rates: dict[tuple[str, str], float] = field(default_factory=dict)
    dense: list[float] = field(default_factory=list)
    base: float = 0.01

    def __post_init__(self) -> None:
        self.automaton = Automaton(w for w in self.words if allowed(w))
        self.seen: set[str] = set()
        self.found: dict[str, tuple[str, str]] = {}

    def kinds(self, words: list[str]) -> dict[str, tuple[str, str]]:
        """What kind of hit, on which entry, each word that is one is; remembered from text to text."""
        new = set(words).difference(self.seen)
        if new:
            if len(self.seen) + len(new) > CACHE_WORDS:
                self.seen, self.found, new = set(), {}, set(words)
            self.seen |= new
            for w in new:
                if kind := self.of_token(w):
                    self.found[w] = kind
        return self.found

    def of_token(self, token: str) -> tuple[str, str] | None:
        """The hit of what stands between white space: as one word, or else the first of its parts between letters that is one."""
        word = normal_word(token)
        if (kind := self.match(word)) or word.isalpha() and len(word) == len(token):
            return kind
        parts = _INNER.split(token.lower())
        return next((kind for p in parts if p != word and (kind := self.match(p))), None)

    def match(self, word: str) -> tuple[str, str] | None:
        if word in self.words:
            return KINDS[0], word
        found = self.automaton.nearest(word)
        return found and (KINDS[found[0]], found[1])


def allowed(word: str) -> int:
    """Edits that still are a misspelling of a word of this length."""
    return 0 if len(word) < 5 else 1 if len(word) < 8 else 2


Place = tuple[int, str]


class Automaton:
    """All words that misspell an entry: the trie of entries under insertions, deletions, changes and swaps of letters.

    A place is a node of the trie, and a letter that has to come next if the two before it in the
    entry are being read as swapped. A state is a set of places with the least edits to each.
    """

    def __init__(self, entries: Iterable[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        #: The most edits that any entry at or below a node allows.
        self.most = [0]
        for entry in entries:
            node, edits = 0, allowed(entry)
            self.most[0] = max(self.most[0], edits)
            for c in entry:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], edits)
            self.ends[node] = entry
        self.restart()

    def restart(self) -> None:
        self.numbers: dict[frozenset[tuple[Place, int]], int] = {}
        self.states: list[dict[Place, int]] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, str] | None] = []
        self.start = self.number({(0, ""): 0})

    def number(self, places: dict[Place, int]) -> int:
        """The state of these places and of those reached by leaving out letters of entries; -1 for none."""
        waiting = [p for p in places if not p[1]]
        while waiting:
            node, _ = waiting.pop()
            edits = places[node, ""] + 1
            for child in self.children[node].values():
                if edits <= self.most[child] and edits < places.get((child, ""), 9):
                    places[child, ""] = edits
                    waiting.append((child, ""))
        if not places:
            return -1
        key = frozenset(places.items())
        state = self.numbers.get(key)
        if state is None:
            state = self.numbers[key] = len(self.states)
            self.states.append(places)
            self.steps.append({})
            ends = [(e, self.ends[n]) for (n, wait), e in places.items() if not wait and n in self.ends and 0 < e <= allowed(self.ends[n])]
            self.accepts.append(min(ends, default=None))
        return state

    def step(self, state: int, c: str) -> int:
        after: dict[Place, int] = {}

        def reach(node: int, wait: str, edits: int) -> None:
            if edits <= self.most[node] and edits < after.get((node, wait), 9):
                after[node, wait] = edits

        for (node, wait), edits in self.states[state].items():
            if wait:
                if wait == c:
                    reach(node, "", edits)
                continue
            reach(node, "", edits + 1)
            for x, child in self.children[node].items():
                reach(child, "", edits + (x != c))
                if x != c and (swapped := self.children[child].get(c)) is not None:
                    reach(swapped, x, edits + 1)
        to = self.steps[state][c] = self.number(after)
        return to

    def nearest(self, word: str) -> tuple[int, str] | None:
        """Edits to the nearest entry that allows them, 1 or 2, and that entry, the first by alphabet of several."""
        if len(self.states) > MOST_STATES:
            self.restart()
        state = self.start
        for c in word:
            to = self.steps[state].get(c)
            state = self.step(state, c) if to is None else to
            if state < 0:
                return None
        return self.accepts[state]


Hit = tuple[int, tuple[str, str], bool]


def density_of(weight: float, n_hits: int, n_words: int) -> int:
    """The class of density of hits of this total rate: 0 for none or one, then by powers of two in a thousand words."""
    if n_hits < 2 or weight <= 0:
        return 0
    return 1 + min(max(int(math.log2(1000 * weight / n_words)), 0), DENSITIES - 2)


def hits(text: str, lexicon: Lexicon) -> tuple[list[Hit], int]:
    """(position, (kind, entry), quoted) of each hit, and the number of words."""
    words = text.split()
    kinds = lexicon.kinds(words)
    found = [(i, kinds[w]) for i, w in enumerate(words) if w in kinds]
    if not found:
        return [], len(words)
    inside, depth, either = [], 0, False
    last = found[-1][0]
    for w in words[: last + 1]:
        opens = sum(w.count(c) for c in OPENING)
        marks = w.count(EITHER)
        inside.append(depth + opens > 0 or either or marks > 0)
        depth = max(0, depth + opens - sum(w.count(c) for c in CLOSING))
        either ^= marks % 2 == 1
    out = []
    for i, k in found:
        near = words[max(0, i - CONTEXT) : i]
        reported = any(normal_word(w) in SAYING for w in near) and any(w[-1] in ":,\"“„«" for w in near)
        out.append((i, k, inside[i] or reported))
    return out, len(words)


def score(found: list[Hit], n_words: int, lexicon: Lexicon) -> float:
    """From 0 to 1: the strongest hit's evidence in its context, or that of all hits by density, over that of a text without one."""
    start = math.log(lexicon.base / (1 - lexicon.base))
    if not found:
        return 1 / (1 + math.exp(-start))
    evidence = [lexicon.weights.get(k, 0.0) * (QUOTED if quoted else 1) for _, k, quoted in found]
    weight = sum(lexicon.rates.get(k, 0.0) * (QUOTED if quoted else 1) for _, k, quoted in found)
    if dense := density_of(weight, len(found), n_words):
        evidence.append(lexicon.dense[dense] if lexicon.dense else 0.0)
    places = [i for i, _, _ in found]
    around = max(sum(abs(i - j) <= CONTEXT for j in places[max(0, n - CONTEXT) : n + CONTEXT + 1]) - 1 for n, i in enumerate(places))
    top = max(evidence)
    total = start + top + (0.1 * math.log1p(around) if top > 0 else 0)
    return 1 / (1 + math.exp(-total))


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def surprise(toxic: str, clean: str, prior: float, tried: int) -> Column:
    """Nats by which a share of toxic texts beats chance, less those for the number of words tried."""
    n = F.col(toxic) + F.col(clean)
    p = F.col(toxic) / n
    rest = F.when(F.col(clean) > 0, (1 - p) * F.log((1 - p) / (1 - prior))).otherwise(0.0)
    return n * (p * F.log(p / prior) + rest) - math.log(max(tried, 1))


def without_copies(rows: DataFrame, key: str) -> DataFrame:
    """Keys of the rows that share none of their minimum hashes with a row of smaller key and the same label."""
    words = F.array_remove(F.split("whole", r"\s+"), "")
    n = F.size("w")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, SHINGLE)))
    least = F.array(*(F.struct(F.lit(k).alias("k"), F.array_min(F.transform("grams", lambda g, _: g.bitwiseXOR(F.lit(order)))).alias("h")) for k, order in enumerate(ORDERS)))
    spread = rows.select(key, "toxic", words.alias("w")).select(key, "toxic", grams.alias("grams")).select(key, "toxic", F.explode(least).alias("m"))
    first = spread.groupBy("toxic", "m").agg(F.min(key).alias(key))
    return first.groupBy(key).count().filter(F.col("count") == len(ORDERS)).select(key)


def learn(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Lexicon:
    """The lexicon and its weights, from the labelled rows that are not held out."""
    require(labels, (key, label))
    marked = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).alias("toxic"))
    rows = documents.select(key, text_or_empty(text).alias("whole")).join(marked, key)
    # Toxic and clean texts are told apart, so that no copy hides one of the other kind.
    rows = stored(rows.join(without_copies(rows, key), key, "left_semi").select("toxic", "whole"), "labelled-texts")
    words = rows.select("toxic", F.explode(F.array_distinct(F.split(F.lower("whole"), r"[^\p{L}\p{N}]+"))).alias("word")).filter(F.length("word") > 2)
    tally = (F.sum(F.col("toxic").cast("long")).alias("bad"), F.sum((1 - F.col("toxic")).cast("long")).alias("good"))
    by_word = stored(words.groupBy("word").agg(*tally), "labelled-words")
    texts = rows.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    if not texts["bad"] or texts["bad"] == texts["n"]:
        discard(rows, by_word)
        return Lexicon({})
    sure = by_word.filter((F.col("bad") > 2) & (F.col("bad") >= SHARE * (F.col("bad") + F.col("good")))).withColumn("nats", surprise("bad", "good", texts["bad"] / texts["n"], by_word.count()))
    # Bounded by MOST_ENTRIES words.
    found = sure.filter(F.col("nats") > SURPRISE).orderBy(F.desc("nats"), "word").limit(MOST_ENTRIES).collect()
    lexicon = weighed(rows, Lexicon({r["word"]: (r["bad"] / (r["bad"] + r["good"]), r["bad"]) for r in found}))
    discard(rows, by_word)
    return lexicon


def cautious(share: float, n: float) -> float:
    """The least share that so many texts with this one are compatible with (Wilson's bound)."""
    z = CAUTION
    return (share + z * z / (2 * n) - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def weighed(rows: DataFrame, lexicon: Lexicon) -> Lexicon:
    """The lexicon with what its hits are worth, learned from labelled texts (toxic, whole)."""

    @F.pandas_udf("struct<n_words: long, hits: array<struct<kind: string, entry: string, open: int, quoted: int>>>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sizes, all_hits = [], []
            for t in texts:
                found, n_words = hits(t, lexicon)
                open_, quoted = (Counter(k for _, k, q in found if q == side) for side in (False, True))
                sizes.append(n_words)
                all_hits.append([(*k, open_[k], quoted[k]) for k in sorted(open_ | quoted)])
            yield pd.DataFrame({"n_words": sizes, "hits": all_hits})

    seen = stored(rows.select("toxic", F.monotonically_increasing_id().alias("text"), counted("whole").alias("x")).select("toxic", "text", "x.n_words", "x.hits"), "labelled-hits")
    of_texts = {r["toxic"]: r for r in seen.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"), F.sum((F.size("hits") == 0).cast("long")).alias("none")).collect()}
    each = seen.select("toxic", "text", "n_words", F.explode("hits").alias("h"))
    open_hits = each.filter("h.open > 0").groupBy("h.kind", "h.entry").agg(
        F.sum(F.col("toxic").cast("long")).alias("bad"), F.count("*").alias("n"),
        F.sum(F.col("h.open") * F.col("toxic")).alias("bad_times"), F.sum(F.col("h.open") * (1 - F.col("toxic"))).alias("good_times"),
    )
    # At most three kinds for each entry.
    counts = {(r["kind"], r["entry"]): r for r in open_hits.collect()}
    odds = lambda p: math.log(p / (1 - p))
    base = (of_texts[1]["none"] + 0.1) / (of_texts[1]["none"] + of_texts[0]["none"] + 10)
    weights, rates = {}, {}
    for kind, belief, doubt in zip(KINDS, BELIEF, DOUBT, strict=True):
        for entry, (share, texts) in lexicon.words.items():
            r = counts.get((kind, entry))
            bad, n = (r["bad"], r["n"]) if r else (0, 0)
            # Hits that were seen little lean on what the entry itself is; the less so the less that was seen.
            toxic = (bad + 4 * belief * share * texts / (texts + doubt)) / (n + 4)
            weights[kind, entry] = odds(min(max(cautious(toxic, max(n, texts / 2)), 0.001), 0.999)) - odds(base)
            if r:
                rate = math.log((r["bad_times"] + 0.3) / of_texts[1]["words"]) - math.log((r["good_times"] + 0.3) / of_texts[0]["words"])
                rates[kind, entry] = max(0.0, rate)
    # Three rows for each entry at most.
    rated = rows.sparkSession.createDataFrame([(*k, r) for k, r in rates.items()] or [("", "", 0.0)], "kind string, entry string, rate double")
    worth = each.select("toxic", "text", "n_words", "h.*").join(F.broadcast(rated), ["kind", "entry"], "left").withColumn("weight", F.coalesce("rate", F.lit(0.0)) * (F.col("open") + QUOTED * F.col("quoted")))
    dense = worth.groupBy("toxic", "text", "n_words").agg(F.sum("weight").alias("weight"), F.sum(F.col("open") + F.col("quoted")).alias("n_hits")).filter("n_hits > 1 and weight > 0")
    power = F.greatest(F.floor(F.log2(1000 * F.col("weight") / F.col("n_words"))), F.lit(0))
    counted_classes = dense.groupBy((1 + F.least(power, F.lit(DENSITIES - 2))).alias("density"), "toxic").count().collect()
    by_class = {(r["density"], r["toxic"]): r["count"] for r in counted_classes}
    levels = []
    for k in range(DENSITIES):
        # A class has at least the evidence of the one below.
        bad, good = by_class.get((k, 1), 0), by_class.get((k, 0), 0)
        own = odds(min((bad + 0.5) / (bad + good + 2), 0.999)) - odds(base)
        levels.append(max([own, *levels[-1:]]) if k else 0.0)
    discard(seen)
    return Lexicon(lexicon.words, weights, rates, levels, base)


def score_toxicity(documents: DataFrame, lexicon: Lexicon, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, score, predicted, and the number of hits."""
    require(documents, (key, text))

    @F.pandas_udf("struct<score: double, n_hits: long>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [hits(t, lexicon) for t in texts]
            yield pd.DataFrame({"score": [score(h, n, lexicon) for h, n in found], "n_hits": [len(h) for h, _ in found]})

    out = documents.select(key, held_out(key).alias("held_out"), scored(text_or_empty(text)).alias("s"))
    return out.select(key, "held_out", "s.score", (F.col("s.score") >= threshold).cast("int").alias("predicted"), "s.n_hits")
