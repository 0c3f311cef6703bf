"""Near-duplicate classes by consistent weighted sampling of TF-IDF shingles.

A text is a weighted set of five-word shingles: how often a shingle occurs times the mean inverse
document frequency of its words, scaled to lie between 1 and 2. Word frequencies are counted over
all documents in hashed buckets, a table of fixed size. (A shingle's own document frequency is
the size of its group of copies, so it would weaken the very evidence looked for.)

Improved consistent weighted sampling draws samples that two texts share with the probability of
their weighted Jaccard similarity; bands of samples make buckets. In a bucket, every text is
verified against one of them, the hub. Verified links make components, and a bucket whose texts are
all of one component is settled. In what is left, shingles are counted: what a text shares with no
other text there bounds its similarity to each of them, so texts with many changes of their own are known
to have no partner and go, however large their group. Then hubs of the largest component meet the texts
outside it, and hubs outside it meet all others, for some turns (``STARS``); at last all pairs across
components are verified: those of small buckets one by one, those of large ones by pairs of blocks.
So every two texts that share a bucket end in one class or are known to be unlike; no bucket is
thinned. Blocks of one and the same component are not paired. Exact copies are collapsed beforehand.

Null and empty texts, and texts without a word, are copies of their like only. Texts of fewer than
five words are one shingle. Rows are told apart by id and text, so rows that share an id but no text
are in the classes of their texts; a class of rows without any id has the class id null. Equal rows
share a class. Columns other than key and text are ignored, whatever their names. A very long text
is held by one task, with its hub. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import discard, require, stored, text_or_empty

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 10, 3
#: Turns of hubs in contested buckets before their pairs are verified, the most texts of a bucket whose
#: pairs are rows, and what a block holds: texts, of at most so many characters each on average.
STARS, PAIRED, BLOCK, BLOCK_CHARS = 1, 16, 512, 4096
#: Word buckets, and the pieces in which their counts are added up.
BUCKETS, PIECES = 1 << 18, 64
#: Shingles that are sampled together, and texts whose shingles are handed on together.
CHUNK, CUT_TOGETHER = 1024, 250

_STEPS = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(WORDS)], np.uint64)
_SEEDS = np.array([(k + 1) * 0xD1B54A32D192ED03 % (1 << 64) for k in range(BANDS * ROWS)], np.uint64)


def _gamma_quantiles(u: np.ndarray) -> np.ndarray:
    """Where the distribution Gamma(2, 1) reaches ``u``, by Newton's method."""
    x = np.sqrt(2 * u)
    for _ in range(60):
        x -= (1 - np.exp(-x) * (1 + x) - u) / (x * np.exp(-x))
    return x


_LEVELS = 1 << 16
#: Gamma(2, 1) variables at the edges of equal steps of probability, in the middle of each step, and log edges.
_EDGES = np.concatenate([[0.0], _gamma_quantiles(np.append(np.arange(1, _LEVELS), _LEVELS - 0.25) / _LEVELS)])
_MIDDLES = _gamma_quantiles((np.arange(_LEVELS) + 0.5) / _LEVELS)
_MIDDLES_32 = _MIDDLES.astype(np.float32)
_LOG_EDGES = np.concatenate([[-20.0], np.log(_EDGES[1:-1])]).astype(np.float32)


def word_hashes(text: str) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def weighted_shingles(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and their weights."""
    words = word_hashes(text)
    if not len(words):
        return words, np.zeros(0, np.float32)
    size = min(WORDS, len(words))
    n = len(words) - size + 1
    known = idf[(words % np.uint64(BUCKETS)).astype(np.int64)]
    mixed, mean = np.zeros(n, np.uint64), np.zeros(n, np.float32)
    for j in range(size):
        mixed += words[j : j + n] * _STEPS[j]
        mean += known[j : j + n]
    shingles, first, counts = np.unique(mixed, return_index=True, return_counts=True)
    return shingles, mean[first] / np.float32(size) * counts.astype(np.float32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    either = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - shared
    return shared / either if either else 1.0


def _mixed(x: np.ndarray) -> np.ndarray:
    """``x`` with all bits mixed, in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def _drawn(bits: np.ndarray, log_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value that a shingle has for a seed (the least wins) and its level, from 64 bits as four parts."""
    beta = (bits[:, 0] + 0.5) / _LEVELS
    low = bits[:, 2].astype(np.int64)
    part = (bits[:, 1] + 0.5) / _LEVELS
    root = np.sqrt(2 * (low + part) / _LEVELS)
    near_0 = root + root**2 / 3 + 11 / 72 * root**3
    c = np.where(low < 64, near_0, _EDGES[low] + part * (_EDGES[low + 1] - _EDGES[low]))
    r = _MIDDLES[bits[:, 3]]
    level = np.floor(log_weight / r + beta)
    return np.log(c) - r * (level - beta + 1), level.astype(np.int64)


def weighted_samples(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One sample (as a 32-bit hash) per seed; two sets agree in a share that is their similarity.

    All shingles get a value that is too low by at most one step of the table of log c. Only those
    for which it is at most the least value found are worked out.
    """
    seeds = np.arange(len(_SEEDS))
    best, sample = np.full(len(_SEEDS), np.inf), np.zeros(len(_SEEDS), np.uint64)
    log_weights = np.log(weights.astype(np.float64))
    for at in range(0, len(shingles), CHUNK):
        part, log_weight = shingles[at : at + CHUNK], log_weights[at : at + CHUNK]
        mixed = _mixed(part + _SEEDS[:, None])
        bits = mixed.view(np.uint16).reshape(len(_SEEDS), len(part), 4)
        # With f the fraction of log_weight / r + beta, the value is log c - r (1 - f) - log_weight.
        log_weight_32 = log_weight.astype(np.float32)
        r = _MIDDLES_32.take((mixed >> np.uint64(48)).view(np.intp), mode="clip")
        level = log_weight_32 / r
        level += bits[:, :, 0] * np.float32(1 / _LEVELS)
        level -= np.floor(level)
        level -= np.float32(1)
        level *= r
        level -= log_weight_32
        mixed >>= np.uint64(32)
        mixed &= np.uint64(_LEVELS - 1)
        level += _LOG_EDGES.take(mixed.view(np.intp), mode="clip")
        likely = level.argmin(1)
        drawn = mixed_bits(part[likely], seeds)
        value, _ = _drawn(drawn, log_weight[likely])
        limit = (np.minimum(best, value) + 1e-3).astype(np.float32)
        row, col = np.divmod(np.flatnonzero(level <= limit[:, None]), len(part))
        value, step = _drawn(mixed_bits(part[col], row), log_weight[col])
        order = np.lexsort((col, value, row))  # equal values go to the smaller shingle
        first = order[np.append(True, row[order][1:] != row[order][:-1])[: len(order)]]
        first = first[value[first] < best[row[first]]]
        best[row[first]] = value[first]
        sample[row[first]] = part[col[first]] + step[first].astype(np.uint64) * _STEPS[0]
    return (_mixed(sample) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def mixed_bits(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The bits that each shingle draws for the seed beside it, as four parts."""
    return _mixed(shingles + _SEEDS[seeds]).view(np.uint16).reshape(-1, 4)


def inverse_frequencies(documents: DataFrame, text: str) -> np.ndarray:
    """Per word bucket: 1 + ln((1 + N) / (1 + n)) / ln(1 + N). BUCKETS numbers, whatever the input."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, rows = np.zeros(BUCKETS, np.int32), 0
        for batch in batches:
            for t in batch["whole"]:
                counts[np.unique((word_hashes(t) % np.uint64(BUCKETS)).astype(np.int64))] += 1
                rows += 1
        if rows:
            pieces = np.split(counts, PIECES)
            yield pd.DataFrame({"piece": range(PIECES), "n": [rows] * PIECES, "counts": [p.tobytes() for p in pieces]})

    def added(piece: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in piece["counts"])
        return pd.DataFrame({"piece": piece["piece"].iloc[:1], "n": [piece["n"].sum()], "counts": [total.tobytes()]})

    schema = "piece int, n long, counts binary"
    parts = documents.select(text_or_empty(text).alias("whole")).mapInPandas(counted, schema).groupBy("piece").applyInPandas(added, schema).collect()
    if not parts:
        return np.ones(BUCKETS, np.float32)
    counts = np.concatenate([np.frombuffer(p["counts"], np.int64) for p in sorted(parts, key=lambda p: p["piece"])])
    n = parts[0]["n"]
    return (1 + np.log((1 + n) / (1 + counts)) / np.log(1 + n)).astype(np.float32)


def _row_key(key: str, text: str) -> list[Column]:
    """What tells rows apart: the id, and a digest of the text."""
    return [F.col(key).cast("long").alias("id"), F.unhex(F.md5(text_or_empty(text).cast("binary"))).alias("digest")]


def signed(documents: DataFrame, idf: np.ndarray, key: str, text: str) -> DataFrame:
    """id, digest of the text, and its samples (empty for a text without words)."""
    shared = documents.sparkSession.sparkContext.broadcast(idf)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples = []
            for t in batch.column("whole"):
                shingles, weights = weighted_shingles(t.as_py(), shared.value)
                samples.append(weighted_samples(shingles, weights) if len(shingles) else [])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(samples, pa.list_(pa.int32()))], ["id", "digest", "samples"])

    rows = documents.select(*_row_key(key, text), text_or_empty(text).alias("whole"))
    return rows.mapInArrow(task, "id long, digest binary, samples array<int>")


def blocks_of(size: str) -> Column:
    """How many texts of usual length one of ``size`` characters counts as, for blocks."""
    return F.greatest(F.lit(1.0), F.col(size) / BLOCK_CHARS)


def links_of(pairs: DataFrame, whole: DataFrame, idf: np.ndarray, similar: float) -> DataFrame:
    """The ``pairs`` (a, b) of similar texts. Texts of many b meet one of a, which is sent once for each block of them."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    sized = pairs.join(whole.select(F.col("node").alias("b"), "size"), "b")
    blocks = stored(sized.groupBy("a").agg(F.ceil(F.sum(blocks_of("size")) / BLOCK).alias("blocks")), "hub-blocks", few=True)
    dealt = pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), "blocks").alias("block"), F.col("b").alias("node"))
    hubs = blocks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("a").alias("node"))
    texts = dealt.union(hubs).join(whole.select("node", "whole"), "node")
    ordered = texts.repartition("a", "block").sortWithinPartitions("a", "block", F.col("node") != F.col("a"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            a, b = [], []
            for h, n, t in zip(batch.column("a").to_pylist(), batch.column("node").to_pylist(), batch.column("whole"), strict=True):
                if h == n:
                    hub, own = h, weighted_shingles(t.as_py(), shared.value)
                elif similarity(own, weighted_shingles(t.as_py(), shared.value)) >= similar:
                    a.append(hub)
                    b.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    found = stored(ordered.select("a", "node", "whole").mapInArrow(task, "a long, b long"), "links", few=True)
    discard(blocks)
    return found


def alike_in_blocks(first: list[tuple[np.ndarray, np.ndarray]], second: list[tuple[np.ndarray, np.ndarray]], similar: float) -> np.ndarray:
    """For each text of ``first``, whether each text of ``second`` is similar: exact, by postings of shingles."""
    at = np.repeat(np.arange(len(second)), [len(x) for x, _ in second])
    shingles, weights = np.concatenate([x for x, _ in second]), np.concatenate([w for _, w in second])
    order = np.argsort(shingles, kind="stable")
    shingles, weights, at = shingles[order], weights[order], at[order]
    totals = np.array([w.sum(dtype=np.float64) for _, w in second])
    out = np.zeros((len(first), len(second)), bool)
    for n, (x, w) in enumerate(first):
        low = np.searchsorted(shingles, x, "left")
        counts = np.searchsorted(shingles, x, "right") - low
        where = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        shared = np.bincount(at[where], np.minimum(weights[where], np.repeat(w, counts)), len(second))
        out[n] = shared >= similar * (w.sum(dtype=np.float64) + totals - shared)
    return out


def contested(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` (band, bucket, node, own) with their labels, of buckets that hold several components.

    Per bucket: how many texts it holds, and ``main``, the label of most of them.
    """
    labelled = members.select("band", "bucket", "node", "own").join(labels.select("node", "label"), "node", "left").select("band", "bucket", "node", "own", F.coalesce("label", "node").alias("label"))
    labelled = stored(labelled, "labelled", few=True)
    shares = labelled.groupBy("band", "bucket", "label").count()
    mixed = shares.groupBy("band", "bucket").agg(F.sum("count").alias("n"), F.count("*").alias("labels"), F.max(F.struct("count", "label")).alias("most"), F.sum(F.col("count") ** 2).alias("within")).filter("labels > 1")
    mixed = stored(mixed.select("band", "bucket", "n", F.col("most.label").alias("main"), ((F.col("n") ** 2 - F.col("within")) / 2).alias("pairs")), "mixed-buckets", few=True)
    out = stored(labelled.join(mixed, ["band", "bucket"]), "contested", few=True)
    discard(labelled, mixed)
    return out


def with_partners(members: DataFrame, whole: DataFrame, idf: np.ndarray, similar: float) -> DataFrame:
    """``members`` without those that are provably unlike all others of their bucket.

    If the shingles that any other text of ``members`` holds weigh s of a text's t, its similarity to a text
    of weight u is at most s / (t + u - s), and none if u is not between ``similar`` * t and t / ``similar``.
    """
    shared = members.sparkSession.sparkContext.broadcast(idf)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A text's shingles are larger than the text, so few texts are cut together.
        for batch in (b.slice(at, CUT_TOGETHER) for b in batches for at in range(0, b.num_rows, CUT_TOGETHER)):
            sets = [weighted_shingles(t.as_py(), shared.value) for t in batch.column("whole")]
            nodes = np.repeat(batch.column("node").to_numpy(), [len(x) for x, _ in sets])
            # Half a hash will do: shingles that share one only seem to be held by more texts.
            shingles = np.concatenate([(x >> np.uint64(32)).astype(np.uint32).view(np.int32) for x, _ in sets] or [np.zeros(0, np.int32)])
            weights = np.concatenate([w for _, w in sets] or [np.zeros(0, np.float32)])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(shingles, pa.int32()), pa.array(weights, pa.float32())], ["node", "shingle", "weight"])

    texts = whole.join(members.select("node").distinct(), "node", "left_semi").select("node", "whole")
    shingles = stored(texts.mapInArrow(cut, "node long, shingle int, weight float"), "contested-shingles", few=True)
    held_twice = stored(shingles.groupBy("shingle").count().filter("count > 1").select("shingle"), "shared-shingles", few=True)
    total = shingles.groupBy("node").agg(F.sum("weight").alias("total"))
    common = shingles.join(held_twice, "shingle").groupBy("node").agg(F.sum("weight").alias("common"))
    weighed = stored(total.join(common, "node").select("node", "total", "common"), "shared-weights", few=True)
    placed = members.select("band", "bucket", "node").join(weighed, "node").withColumn("place", F.floor(1e6 * F.log("total")).cast("long"))
    reach = int(1e6 * -np.log(similar)) + 2
    least = F.min("total").over(Window.partitionBy("band", "bucket").orderBy("place").rangeBetween(-reach, reach))
    alive = placed.withColumn("least", least).filter(F.col("least") <= (1 + 1e-6) * ((1 + similar) / similar * F.col("common") - F.col("total")))
    # Of the weight, what no other text holds, in steps of 1 / 50.
    out = stored(alive.select("band", "bucket", "node", F.floor(50 * (1 - F.col("common") / F.col("total"))).alias("own")), "members", few=True)
    discard(shingles, held_twice, weighed)
    return out


def star_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of hubs of contested buckets with texts of other components."""
    # Texts with the least of their own are like most others.
    at = F.struct("own", F.xxhash64("node", "band", F.lit(turn)).alias("hash"), "node", "label")
    hubs = members.groupBy("band", "bucket").agg(F.min(F.when(F.col("label") == F.col("main"), at)).alias("x"), F.min(F.when(F.col("label") != F.col("main"), at)).alias("y"))
    hubs = stored(hubs.select("band", "bucket", F.explode(F.array("x", "y")).alias("hub")).select("band", "bucket", F.col("hub.node").alias("a"), F.col("hub.label").alias("of")), "hubs", few=True)
    pairs = members.join(hubs, ["band", "bucket"]).filter("label <> of").select("a", F.col("node").alias("b")).distinct()
    pairs = stored(pairs, "star-pairs", few=True)
    discard(hubs)
    return pairs


def links_across(members: DataFrame, whole: DataFrame, idf: np.ndarray, similar: float) -> list[DataFrame]:
    """Links (a, b) of all pairs of contested ``members`` that share a bucket and no label."""
    few = members.filter(F.col("n") <= PAIRED).select("band", "bucket", "node", "label")
    other = few.select("band", "bucket", F.col("node").alias("b"), F.col("label").alias("other"))
    pairs = stored(few.withColumnRenamed("node", "a").join(other, ["band", "bucket"]).filter("a < b and label <> other").select("a", "b").distinct(), "pairs", few=True)
    found = links_of(pairs, whole, idf, similar)
    many = members.filter(F.col("n") > PAIRED).join(whole.select("node", "size"), "node")
    before = Window.partitionBy("band", "bucket").orderBy("label", "node").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(blocks_of("size")).over(before), F.lit(0.0))
    blocked = stored(many.select("band", "bucket", "node", "label", F.floor(ahead / BLOCK).alias("block")), "blocks", few=True)
    blocks = blocked.groupBy("band", "bucket", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    left, right = (blocks.select("band", "bucket", F.col("block").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}")) for x in "ij")
    met = left.join(right, ["band", "bucket"]).filter("i <= j and (low_i <> high_i or low_j <> high_j or low_i <> low_j)").select("band", "bucket", "i", "j")
    sides = met.select("*", F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("block"))
    shared = members.sparkSession.sparkContext.broadcast(idf)

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        nodes, labels = group["node"].to_numpy(), group["label"].to_numpy()
        sets = [weighted_shingles(t, shared.value) for t in group["whole"]]
        here = np.flatnonzero((group["block"] == group["i"]).to_numpy())
        there = np.flatnonzero((group["block"] == group["j"]).to_numpy())
        alike = alike_in_blocks([sets[n] for n in here], [sets[n] for n in there], similar)
        a, b = np.nonzero(alike & (labels[here][:, None] != labels[there][None, :]))
        # Links of one block pair that make no new connection are not returned.
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = root[x]
            return x

        out = []
        for x, y in zip(here[a], there[b], strict=True):
            p, q = top(labels[x]), top(labels[y])
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((nodes[x], nodes[y]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    texts = sides.join(blocked, ["band", "bucket", "block"]).join(whole.select("node", "whole"), "node")
    more = stored(texts.groupBy("band", "bucket", "i", "j").applyInPandas(settle, "a long, b long"), "links", few=True)
    discard(pairs, blocked)
    return [found, more]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, label (the smallest node of its component) of every end of an edge (a, b)."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges", few=True)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), f"{name}-labels", few=True)
    while True:
        of_neighbour = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(of_neighbour, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        # A label's own label is at least as small: following it halves the paths.
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stored(nearer.join(jump, "label", "left").select("node", F.least("label", "further").alias("label"), "was"), f"{name}-labels", few=True)
        changed = new.filter("label <> was").limit(1).count()
        discard(labels)
        labels = new.drop("was")
        labels._stored_at = new._stored_at
        if not changed:
            discard(both)
            return labels


def merged(labels: DataFrame | None, *links: DataFrame) -> DataFrame:
    """Labels after further links; an old label stands for its whole component."""
    edges = [] if labels is None else [labels.select(F.col("node").alias("a"), F.col("label").alias("b"))]
    for found in links:
        edges.append(found.select("a", "b"))
    union = edges[0]
    for more in edges[1:]:
        union = union.union(more)
    new = components(union)
    discard(*links, *([] if labels is None else [labels]))
    return new


def text_classes(documents: DataFrame, similar: float, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, digest) of every row, and (digest, id, class_id, first) of every different text.

    ``id`` is the smallest of the text's rows; ``first`` is true for one text of each class, the one of
    smallest id. Both are stored tables.
    """
    require(documents, (key, text))
    idf = inverse_frequencies(documents, text)
    signs = stored(signed(documents, idf, key, text), "signatures", few=True)
    # Copies of one text are one text from here on, with a number of its own.
    different = signs.groupBy("digest").agg(F.min("id").alias("id"), F.first("samples").alias("samples"))
    texts = stored(different.withColumn("node", F.monotonically_increasing_id()), "texts", few=True)
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.slice("samples", b * ROWS + 1, ROWS)).alias("bucket")))
    spread = texts.filter(F.size("samples") > 0).select("node", F.explode(band).alias("x")).select("node", "x.band", "x.bucket")
    # The first hub is that of smallest hash, so it is the same one in most buckets of a group.
    crowded = spread.groupBy("band", "bucket").agg(F.min(F.struct(F.xxhash64("node").alias("hash"), "node")).alias("hub"), F.count("*").alias("n")).filter("n > 1")
    # Written first, so that both sides of the join are plain exchanges, which Spark can split where a bucket is hot.
    crowded = stored(crowded.select("band", "bucket", F.col("hub.node").alias("a")), "crowded", few=True)
    members = stored(spread.join(crowded, ["band", "bucket"]), "members", few=True)
    wanted = texts.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("id").alias("of"), F.col("digest").alias("content"))
    rows = documents.select(*_row_key(key, text), text_or_empty(text).alias("whole"))
    # By id as well, so that the copies of a text are not dealt to one task.
    found = rows.join(wanted, (F.col("digest") == F.col("content")) & F.col("id").eqNullSafe(F.col("of")))
    whole = stored(found.select("node", "whole", F.length("whole").alias("size")).dropDuplicates(["node"]), "candidate-texts", few=True)
    pairs = stored(members.filter("node <> a").select("a", F.col("node").alias("b")).distinct(), "star-pairs", few=True)
    labels = merged(None, links_of(pairs, whole, idf, similar))
    discard(crowded, pairs)
    open_ = contested(members.withColumn("own", F.lit(0)), labels)
    discard(members)
    members = with_partners(open_, whole, idf, similar)
    discard(open_)
    for turn in range(STARS + 1):
        open_ = contested(members, labels)
        discard(members)
        members = open_
        across, n = members.dropDuplicates(["band", "bucket"]).agg(F.coalesce(F.sum("pairs"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n:
            break
        if turn == STARS or across <= 4 * n:
            labels = merged(labels, *links_across(members, whole, idf, similar))
            break
        pairs = star_pairs(members, turn)
        labels = merged(labels, links_of(pairs, whole, idf, similar))
        discard(pairs)
    labelled = texts.select("node", "digest", "id").join(labels, "node", "left").select("digest", "id", F.coalesce("label", "node").alias("label"))
    labelled = stored(labelled, "labelled-texts", few=True)
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest"))
    of_class = stored(labelled.groupBy("label").agg(least.alias("least")).select("label", F.col("least.id").alias("class_id"), F.col("least.digest").alias("content")), "classes", few=True)
    classes = stored(labelled.join(of_class, "label").select("digest", "id", "class_id", (F.col("digest") == F.col("content")).alias("first")), "text-classes", few=True)
    discard(texts, members, whole, labels, labelled, of_class)
    return signs, classes


def near_duplicates(documents: DataFrame, similar: float = SIMILAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and class_id, the smallest id of its class of near duplicates."""
    signs, classes = text_classes(documents, similar, key, text)
    return signs.select(F.col("id").alias(key), "digest").join(classes.select("digest", "class_id"), "digest").select(key, "class_id")


def without_near_duplicates(documents: DataFrame, similar: float = SIMILAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with all its columns: that of smallest id (null last), then of smallest digest.

    Rows that share an id but are no near duplicates all stay; of equal rows one does.
    """
    signs, classes = text_classes(documents, similar, key, text)
    first = classes.filter("first").select(F.col("id").alias("of"), F.col("digest").alias("content"))
    rows = documents.select(F.struct(*documents.columns).alias("row"), *_row_key(key, text))
    kept = rows.join(first, (F.col("digest") == F.col("content")) & F.col("id").eqNullSafe(F.col("of")), "left_semi")
    if signs.groupBy("id", "digest").count().filter("count > 1").limit(1).count():
        kept = kept.groupBy("id", "digest").agg(F.first("row").alias("row"))
    return kept.select("row.*")
