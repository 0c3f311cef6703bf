"""Keyed merges as pure derivations: a stored table and a batch give the table that follows.

Each is one join or one anti join on the keys, whatever the batch; write the result beside the old
files and swap (``sources.files.publish``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import lookup_key
from graphloom.sources.files import kept


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def replace(stored: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows of the batch's keys go, the batch's rows come."""
    return stored.join(batch.select(*keys).distinct(), [*keys], "left_anti").unionByName(batch)


def patch(stored: DataFrame, batch: DataFrame, key: str, column: str) -> DataFrame:
    """One column set where the batch has the key, to null as well; the batch's keys are unique."""
    new = batch.select(F.col(key), F.struct(F.col(column).alias("v")).alias("_new"))
    both = stored.join(new, key, "left")
    return both.withColumn(column, F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col(column))).drop("_new").select(*stored.columns)


def upsert_keeping(stored: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The batch's values where they are not null, else the stored ones; keys are unique in both."""
    others = [c for c in stored.columns if c not in keys]
    both = stored.join(batch.select(*keys, *(F.col(c).alias(f"_{c}") for c in others)), [*keys], "full_outer")
    return both.select(*keys, *(F.coalesce(f"_{c}", c).alias(c) for c in others)).select(*stored.columns)


def replace_slice(stored: DataFrame, batch: DataFrame, of: Column) -> DataFrame:
    """Stored rows of a slice go, the batch's come."""
    return stored.filter(~F.coalesce(of, F.lit(False))).unionByName(batch)


def upsert_venues(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Venues (venue_id, source_venue_id, issn, name) met by source id, else ISSN, else normal name.

    Of batch rows that agree in one of the three, the first in order of source id counts; a stored
    venue takes the first batch row that meets it. Rows that meet none are added with ids after
    the largest.
    """
    normal = lambda df: df.withColumn("_name", lookup_key(F.col("name")))
    new = normal(batch)
    order = [F.col("source_venue_id").asc_nulls_last(), F.col("issn").asc_nulls_last(), F.col("_name").asc_nulls_last()]
    for c in ("source_venue_id", "issn", "_name"):
        new = first_of(new.filter(F.col(c).isNotNull()), [c], order).unionByName(new.filter(F.col(c).isNull()))
    # Written at each step: what follows reads it several times.
    new = kept(new.withColumn("_row", F.struct("source_venue_id", "issn", "_name")), "new-venues")
    old, met = normal(stored), None
    for rank, c in enumerate(("source_venue_id", "issn", "_name")):
        hit = kept(new.join(old.select("venue_id", c), c).select(*new.columns, "venue_id").withColumn("_rank", F.lit(rank)), "known-venues")
        met = hit if met is None else met.unionByName(hit)
        # A row that was met goes no further; rows are known by all three keys, nulls included.
        key = F.to_json("_row", {"ignoreNullFields": "false"})
        new = kept(new.withColumn("_key", key).join(hit.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key"), "new-venues")
    best = first_of(met, ["venue_id"], [F.col("_rank"), *order])
    updates = best.select("venue_id", *(F.col(c).alias(f"_new_{c}") for c in ("source_venue_id", "issn", "name")))
    updated = stored.join(updates, "venue_id", "left").select("venue_id", *(F.coalesce(f"_new_{c}", c).alias(c) for c in ("source_venue_id", "issn", "name")))
    last = stored.agg(F.coalesce(F.max("venue_id"), F.lit(0)).alias("_last"))
    # Venues number in the ten thousands; only those that are new are numbered together.
    added = new.crossJoin(F.broadcast(last)).withColumn("venue_id", F.col("_last") + F.row_number().over(Window.orderBy(*order)))
    return updated.unionByName(added.select(*updated.columns))


def changed(stored: DataFrame, batch: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Batch rows that are new or differ from the stored row of their key; nulls are values."""
    old = stored.select(*keys, F.struct(*columns).alias("_old"))
    return batch.join(old, [*keys], "left").filter(~F.struct(*columns).eqNullSafe(F.col("_old"))).drop("_old")


def by_precedence(rows: DataFrame, keys: Sequence[str], source: str, order: Sequence[Column] = ()) -> DataFrame:
    """One row for each key: that of the smallest source code."""
    return first_of(rows, keys, [F.col(source).asc_nulls_last(), *order])


def deduplicated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.dropDuplicates([*keys])


def filled(rows: DataFrame, known: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` filled from ``known`` (key, column) where it is null; keys are unique there."""
    found = known.select(key, F.col(column).alias("_known"))
    return rows.join(found, key, "left").withColumn(column, F.coalesce(column, "_known")).drop("_known")


def joined_either(rows: DataFrame, known: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """``value`` of ``known`` by ``first`` where a row has it, else by ``second`` among rows without.

    The two cases exclude each other, so each is an equality join and no row is met twice.
    """
    by_first = rows.filter(F.col(first).isNotNull()).join(known.filter(F.col(first).isNotNull()).select(first, value), first, "left")
    by_second = rows.filter(F.col(first).isNull()).join(known.filter(F.col(first).isNull()).select(second, value), second, "left")
    return by_first.unionByName(by_second)


def best_match(rows: DataFrame, known: DataFrame, key: str, ways: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each row with the best of ``known`` that shares one of ``ways``; earlier ways are better.

    One equality join for each way and one group for each row stand for a lateral top-1 with OR. Of the known
    rows with one value of a way only the first by ``order`` can be the best, so only that one meets the rows.
    """
    hits = None
    for rank, way in enumerate(ways):
        first = known.groupBy(way).agg(F.min(F.struct(F.lit(rank).alias("rank"), *order)).alias("hit"))
        hit = rows.select(key, way).join(first, way).select(key, "hit")
        hits = hit if hits is None else hits.unionByName(hit)
    best = hits.groupBy(key).agg(F.min("hit").alias("hit"))
    return rows.join(best, key, "left").select(rows["*"], *(F.col(f"hit.{c}").alias(f"matched_{c}") for c in order))


def latest(runs: DataFrame, when: str) -> DataFrame:
    return runs.orderBy(F.desc_nulls_last(when)).limit(1)


def reference_metrics(citations: DataFrame) -> DataFrame:
    """Per citing paper: all references, influential ones, those with and without a known target."""
    return citations.groupBy("citing_paper_id").agg(
        F.count("*").alias("reference_out_count"), F.count_if(F.coalesce("is_influential", F.lit(False))).alias("influential_reference_count"),
        F.count("cited_paper_id").alias("linked_reference_count"), F.count_if(F.col("cited_paper_id").isNull()).alias("orphan_reference_count"),
    )


def summed_metrics(*batches: DataFrame) -> DataFrame:
    """Metrics of overlapping batches added up by paper."""
    rows = batches[0]
    for more in batches[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("citing_paper_id").agg(*(F.sum(c).alias(c) for c in rows.columns if c != "citing_paper_id"))


def with_payloads(rows: DataFrame, key: str) -> DataFrame:
    """key and the rest of each row as one JSON text, nulls kept."""
    others = [c for c in rows.columns if c != key]
    return rows.select(key, F.to_json(F.struct(*others), {"ignoreNullFields": "false"}).alias("payload"))


def replaced_spine(stored: dict[str, DataFrame], batch: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """The tables of a document's parts after a batch: of every document in any table of the batch, all stored parts go."""
    touched = None
    for rows in batch.values():
        keys = rows.select(key)
        touched = keys if touched is None else touched.union(keys)
    touched = touched.distinct()
    return {name: rows.join(touched, key, "left_anti").unionByName(batch[name]) for name, rows in stored.items()}
