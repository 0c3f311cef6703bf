"""Mixing of sources to target weights by Pfair scheduling.

Every source's rows are cut into blocks. Block i of a source with weight w is released at slot
floor(i / w) and due at slot ceil((i + 1) / w); in each slot the released block with the earliest
deadline is taken. Weights are taken as they are, as exact fractions, so while sources last, no
source is ever a whole block away from its target, however many blocks or sources there are. When
one runs out, slots are counted anew for those that are left, so no row is dropped; a source of
weight 0 follows after all others. One task works the slots out and holds one block of each source.

Blocks are counted in rows, not in bytes or tokens. A null source is a source of its own. Rows are ordered
within a source by a hash of the key, then by the key, with a null key as good as any, so equal rows may
change places, but nothing else. Null, empty and long texts are carried along unread. Columns may have any
names; those called as one of the four results are replaced by it. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import require

#: Slots that are worked out before they are handed on.
SLOTS_TOGETHER = 10_000
#: Rows of a source that are ranked together in one task.
RANKED_TOGETHER = 4096
#: Sources up to which what is known of each is broadcast (a name and a number); more are joined by a shuffle.
MOST_BROADCAST = 100_000
RESULTS = ("mix_source", "mix_block", "mix_slot", "mix_position")


def schedule(rows: dict[str, int], weights: dict[str, float], block_rows: int) -> Iterator[tuple[str, int, int, int]]:
    """(source, block, slot, position of the block's first row) of all blocks, slot by slot."""
    exact = {s: Fraction(weights[s]) for s in rows}
    common = lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * common) for s, w in exact.items()}
    left = {s: -(-n // block_rows) for s, n in rows.items() if n}
    done = dict.fromkeys(left, 0)
    slot = start = 0
    while left:
        share = {s: whole[s] for s in left if whole[s]} or dict.fromkeys(left, 1)
        total = sum(share.values())
        waiting = [(0, s, 0) for s in sorted(share)]
        ready: list[tuple[int, int, str, int]] = []
        at, s = 0, ""
        while s not in share or s in left:
            while waiting and waiting[0][0] <= at:
                _, s, i = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(i + 1) * total // share[s]), (i + 1) * total // share[s], s, i))
            _, release, s, i = heapq.heappop(ready)
            yield s, done[s], slot, start
            start += min(block_rows, rows[s] - done[s] * block_rows)
            at, slot = at + 1, slot + 1
            done[s] += 1
            left[s] -= 1
            if left[s]:
                heapq.heappush(waiting, (release, s, i + 1))
            else:
                del left[s]


def mix(documents: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, block_rows: int = 64, key: str = "doc_id", source: str = "source") -> DataFrame:
    """All rows and columns, with ``mix_source``, ``mix_block``, ``mix_slot`` and ``mix_position`` (gapless, from 0).

    Without ``weights``, a source's weight is its number of rows to the power ``temperature``.
    A source without a weight gets the smallest. The number of sources must fit the driver: only
    one count for each comes there.
    """
    require(documents, (key, source))
    spark = documents.sparkSession
    row, own = F.struct(*documents.columns).alias("row"), [F.col("row")[c].alias(c) for c in documents.columns if c not in RESULTS]
    named = documents.select(row, F.coalesce(F.col(source).cast("string"), F.lit("\0null")).alias("mix_source"), F.col(key).alias("key"), F.xxhash64(key).alias("hash"))
    rows = dict(named.groupBy("mix_source").count().collect())
    if not rows:
        return named.select(*own, "mix_source", *(F.lit(None).cast("long").alias(c) for c in RESULTS[1:]))
    if weights is None:
        weights = {s: n**temperature for s, n in rows.items()}
    least = min(weights.values())
    weights = {s: weights.get(s, least) for s in rows}
    # A source's rows are ranked in buckets of bounded size, then offset by the buckets before.
    buckets = {s: max(1, n // RANKED_TOGETHER) for s, n in rows.items()}
    small = F.broadcast if len(rows) <= MOST_BROADCAST else lambda df: df
    # From Arrow: rows of a list would pass Python workers of a kind of their own, which then stay beside the others.
    sizes = spark.createDataFrame(pa.table({"mix_source": pa.array(list(buckets), pa.string()), "buckets": pa.array(list(buckets.values()), pa.int32())}))
    salted = named.join(small(sizes), "mix_source").withColumn("bucket", F.pmod("hash", "buckets").cast("int"))
    counts = salted.groupBy("mix_source", "bucket").count()
    before = Window.partitionBy("mix_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("mix_source", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("mix_source", "bucket").orderBy("hash", "key")
    ranked = salted.withColumn("nth", F.row_number().over(within) - 1).join(offsets, ["mix_source", "bucket"]).withColumn("nth", (F.col("nth") + F.col("before")).cast("long"))
    ranked = ranked.withColumn("mix_block", F.expr(f"nth div {block_rows}"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            slots = schedule(rows, weights, block_rows)
            while some := list(islice(slots, SLOTS_TOGETHER)):
                yield pd.DataFrame(some, columns=["mix_source", "mix_block", "mix_slot", "start"])

    plan = spark.range(0, 1, 1, 1).mapInPandas(task, "mix_source string, mix_block long, mix_slot long, start long")
    placed = ranked.join(plan, ["mix_source", "mix_block"])
    position = (F.col("start") + F.col("nth") % block_rows).cast("long").alias("mix_position")
    return placed.select(*own, "mix_source", "mix_block", "mix_slot", position)
