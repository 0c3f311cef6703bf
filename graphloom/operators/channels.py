"""Channels of retrieval: rankings by channel, a boost along citations, and their fusion with traces.

A channel is a table (query_id, id, score). Channels recall papers; citations only lift what was recalled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.retrieval import RANK_CONSTANT
from graphloom.sources.files import kept

#: The channels that recall; ``citation_context`` stands beside them.
RECALLING = ("lexical", "chunk_lexical", "dense_query", "entity_match", "relation_match", "semantic_neighbor")
#: Papers of a channel that count, recalled papers from which citations are followed, and what a full boost adds, in first ranks.
DEPTH, FRONTIER, BOOST = 100, 30, 0.5


def rankings(channels: dict[str, DataFrame], depth: int = DEPTH) -> DataFrame:
    """query_id, channel, id, rank: the first papers of each channel for each query, ties to the smaller id.

    Each channel ranks on its own, so the first of one do not depend on how another scores.
    """
    if unknown := sorted(set(channels) - set(RECALLING)):
        raise ValueError(f"unknown channels: {', '.join(unknown)}")
    rows = None
    for name, scores in channels.items():
        part = scores.select("query_id", F.lit(name).alias("channel"), "id", "score")
        rows = part if rows is None else rows.unionByName(part)
    order = Window.partitionBy("query_id", "channel").orderBy(F.desc("score"), "id")
    best = rows.groupBy("query_id", "channel", "id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth).drop("score")


def recalled(ranks: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, id, fused, trace: reciprocal-rank fusion over channels; the trace has each channel's rank as ``name:rank``, by name."""
    weight = F.coalesce(F.element_at(F.create_map(*(x for n, w in weights.items() for x in (F.lit(n), F.lit(float(w))))), F.col("channel")), F.lit(1.0)) if weights else F.lit(1.0)
    part = (weight / (F.lit(RANK_CONSTANT) + F.col("rank"))).alias("part")
    told = F.concat("channel", F.lit(":"), "rank").alias("told")
    return ranks.select("query_id", "id", part, told).groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("fused"), F.array_join(F.array_sort(F.collect_list("told")), " ").alias("trace"))


def citation_context(found: DataFrame, citations: DataFrame, frontier: int = FRONTIER) -> DataFrame:
    """query_id, id, boost: for papers among ``found`` that the first ``frontier`` of a query cite or are cited by.

    One hop, in both directions; a paper's boost is the sum of the fused scores of the frontier's papers linked to it, over the
    greatest such sum of the query. Only the frontier meets the citations, and a hot paper's links are counted, not kept.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "id")
    first = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= frontier).select("query_id", F.col("id").alias("a"), "fused")
    links = citations.select(F.col("citing").alias("a"), F.col("cited").alias("b")).unionByName(citations.select(F.col("cited").alias("a"), F.col("citing").alias("b"))).filter("a <> b")
    near = links.join(first.select("a").distinct(), "a", "left_semi").distinct()
    met = first.join(near, "a").groupBy("query_id", F.col("b").alias("id")).agg(F.sum("fused").alias("sum"))
    known = met.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi")
    most = known.groupBy("query_id").agg(F.max("sum").alias("most"))
    return known.join(most, "query_id").select("query_id", "id", F.round(F.col("sum") / F.col("most"), 9).alias("boost"))


def search(channels: dict[str, DataFrame], citations: DataFrame, k: int, weights: dict[str, float] | None = None, depth: int = DEPTH, frontier: int = FRONTIER) -> DataFrame:
    """query_id, id, score, rank, trace of the k best papers for each query.

    The score is the fusion of the channels plus a boost along citations, at most ``BOOST`` times a first rank.
    """
    # At most ``depth`` papers of each channel for each query; channels are ranked once for all that reads them.
    found = kept(recalled(rankings(channels, depth), weights), "recalled")
    boosts = citation_context(found, citations, frontier)
    lifted = found.join(boosts, ["query_id", "id"], "left")
    score = F.round(F.col("fused") + F.coalesce("boost", F.lit(0.0)) * BOOST / (RANK_CONSTANT + 1), 9)
    trace = F.when(F.col("boost").isNull(), F.col("trace")).otherwise(F.concat("trace", F.lit(" citation_context")))
    scored = lifted.select("query_id", "id", score.alias("score"), trace.alias("trace"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
