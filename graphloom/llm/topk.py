"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are range partitioned by length, longest first, and packed into buckets of a bounded
number of neighbouring vectors. A query block meets a bucket only if some query's current k-th
score can still be reached with the bucket's longest vector. Within a bucket, the k-th score
divided by both lengths is the local cosine threshold: where it is high, candidates are found by
the feasible range of the query's largest coordinate (coordinate pruning), elsewhere by the
shortest length that can reach the score (length pruning). The inner products of the candidates
are then computed, and per query the k highest are kept.

Vectors that are null, empty, or hold null or non-finite components take no part; nor do rows without a key, nor
vectors longer than 2^31 once scaled, whose products could leave 64 bits. Rows that share a key are different
rows: each is a query of its own, and a candidate of the others. Ties go to the smaller id; equal vectors compete
one by one. Only vectors of the query's dimension are compared. An empty table gives no rows. Columns other than
key and vector are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import require, stored

#: Vectors in a bucket, queries in a block, and the local threshold from which coordinates prune.
BUCKET, BLOCK, COORDINATE_FROM = 2048, 512, 0.7
#: Integers up to here are exact as doubles; vectors up to this length have products that fit 64 bits.
EXACT, LONGEST = 2.0**53, 2.0**31
#: Shares into which the buckets that blocks are held against are dealt.
SHARES = 64

_PACKED = "dim int, number long, longest double, ids array<long>, uids array<long>, asks array<boolean>, content binary"


def integer_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as doubles."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))


def _packs(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (id, v, norm, asks and, perhaps, their number uid) as packed groups of at most ``size``, longest first,
    of one dimension; rows without a number get one."""
    numbered = "uid" in rows.columns

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        number, uid, held = partition << 33, partition << 40, []

        def out(part: list) -> pd.DataFrame:
            nonlocal number
            number += 1
            ids, vectors, norms, asks, uids = zip(*part, strict=True)
            content = np.array(vectors, "<f8")
            return pd.DataFrame({"dim": [content.shape[1]], "number": [number], "longest": [max(norms)], "ids": [list(ids)], "uids": [list(uids)], "asks": [list(asks)], "content": [content.tobytes()]})

        for batch in batches:
            uids = batch["uid"] if numbered else range(uid, uid + len(batch))
            uid += len(batch)
            for row in zip(batch["id"], batch["v"], batch["norm"], batch["asks"], uids, strict=True):
                if held and (len(held) == size or len(held[0][1]) != len(row[1])):
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    ordered = rows.repartitionByRange(F.size("v"), F.desc("norm"), "id").sortWithinPartitions(F.size("v"), F.desc("norm"), "id")
    return stored(ordered.mapInPandas(task, _PACKED), name)


def _asking(buckets: DataFrame) -> DataFrame:
    """The query rows of stored buckets, with their numbers."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                at = np.flatnonzero(row.asks)
                vectors = _matrix(row.content, row.dim)[at]
                yield pd.DataFrame({"id": np.asarray(row.ids)[at], "uid": np.asarray(row.uids)[at], "v": list(vectors), "norm": np.sqrt((vectors**2).sum(1)), "asks": True})

    return buckets.filter(F.exists("asks", lambda x: x)).mapInPandas(task, "id long, uid long, v array<double>, norm double, asks boolean")


def _matrix(content: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(content, "<f8").reshape(-1, dim)


def best_of(queries: np.ndarray, query_uids: np.ndarray, floors: np.ndarray, vectors: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """(number of the query, vector, number of the vector, score) of each query's k best other rows in a bucket
    whose score is its floor or more."""
    lengths = np.sqrt((vectors**2).sum(1))
    own = np.sqrt((queries**2).sum(1))
    exact = own.max(initial=0) * lengths.max(initial=0) < EXACT
    slack = 1e-9
    out = []
    for q in range(len(queries)):
        query, length = queries[q], own[q]
        with np.errstate(divide="ignore", invalid="ignore"):
            needed = floors[q] / length if length else -np.inf
            cosine = needed / lengths[0] if lengths[0] else -np.inf
        if length == 0 and floors[q] > 0 or cosine > 1 + slack:
            continue
        if cosine > COORDINATE_FROM:
            axis = int(np.argmax(np.abs(query)))
            angle = np.arccos(np.clip(query[axis] / length, -1, 1))
            spread = np.arccos(np.clip(np.divide(needed, lengths, out=np.full(len(lengths), 2.0), where=lengths > 0), -1, 1))
            high = np.cos(np.maximum(angle - spread, 0)) * lengths
            low = np.cos(np.minimum(angle + spread, np.pi)) * lengths
            edge = slack * (1 + lengths)
            at = np.flatnonzero((needed <= lengths * (1 + slack)) & (vectors[:, axis] <= high + edge) & (vectors[:, axis] >= low - edge))
        else:
            at = np.arange(np.searchsorted(-lengths, -needed * (1 - slack), side="right") if needed > 0 else len(lengths))
        at = at[uids[at] != query_uids[q]]
        if not len(at):
            continue
        if exact:
            scores = (vectors[at] @ query).astype(np.int64)
        else:
            scores = np.array([sum(int(a) * int(b) for a, b in zip(vectors[i], query, strict=True)) for i in at], dtype=object)
        order = sorted(range(len(at)), key=lambda i: (-scores[i], ids[at[i]], uids[at[i]])) if not exact else np.lexsort((uids[at], ids[at], -scores))
        out += [(int(query_uids[q]), int(ids[at[i]]), int(uids[at[i]]), int(scores[i])) for i in order[:k] if scores[i] >= floors[q]]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each query row, its k highest integer inner products: query_id, rank, key, score."""
    require(vectors, (key, vector))
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    flagged = vectors.filter(usable & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), integer_components(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = flagged.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).filter(F.col("norm") <= LONGEST)
    buckets = _packs(rows, BUCKET, "buckets")
    blocks = _packs(_asking(buckets), BLOCK, "query-blocks")

    def searched(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pairs:
            for row in batch.itertuples(index=False):
                queries, candidates = _matrix(row.q_content, row.dim), _matrix(row.content, row.dim)
                floors = np.full(len(queries), -np.inf) if row.floors is None else np.asarray(row.floors, float)
                found = best_of(queries, np.asarray(row.q_uids), floors, candidates, np.asarray(row.ids), np.asarray(row.uids), k)
                yield pd.DataFrame(found, columns=["query", "id", "uid", "score"])

    asked = blocks.select("dim", F.col("number").alias("block"), F.col("longest").alias("q_longest"), F.col("uids").alias("q_uids"), F.col("content").alias("q_content"))
    schema = "query long, id long, uid long, score long"
    # The first bucket of each dimension gives every query a floor: its k-th score there.
    first = buckets.groupBy("dim").agg(F.min_by("number", F.struct(-F.col("longest"), "number")).alias("number"))
    seeds = buckets.join(first, ["dim", "number"], "left_semi")
    seeded = asked.join(seeds, "dim").select(asked["*"], "content", "ids", "uids", F.lit(None).cast("array<double>").alias("floors")).mapInPandas(searched, schema)
    floor = seeded.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    asking = asked.select("dim", "block", F.posexplode("q_uids").alias("at", "query"))
    floors = asking.join(floor, "query", "left").groupBy("dim", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))).alias("floor")))), lambda s: s["floor"]).alias("floors"))
    floored = asked.join(floors, ["dim", "block"])
    # Blocks meet only the buckets that can still hold a better score for one of their queries; shares of the buckets are held against them apart.
    reach = floored.select("dim", "block", "q_longest", F.array_min("floors").alias("lowest"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    dealt = buckets.select("dim", "number", "longest", F.pmod(F.xxhash64("number"), F.lit(SHARES)).cast("int").alias("share"))
    pairs = reach.join(dealt, ["dim", "share"]).filter(F.col("lowest") <= F.col("q_longest") * F.col("longest") * (1 + 1e-9)).select("dim", "block", "number")
    spread = pairs.join(floored, ["dim", "block"]).join(buckets.select("dim", "number", "ids", "uids", "content"), ["dim", "number"])
    found = spread.repartition(F.col("block"), F.col("number")).select("dim", "q_uids", "q_content", "floors", "ids", "uids", "content").mapInPandas(searched, schema)
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "id", "uid")
    best = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    named = blocks.select(F.explode(F.arrays_zip("uids", "ids")).alias("q")).select(F.col("q.uids").alias("query"), F.col("q.ids").alias("query_id"))
    return best.join(named, "query").select("query_id", "rank", F.col("id").alias(key), "score")
