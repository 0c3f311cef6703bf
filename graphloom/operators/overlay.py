"""Overlays: which points of the universe are shown besides the base, and for whom."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbourhood(focus: DataFrame, universe: DataFrame, active: DataFrame, max_points: int = 5000, max_clusters: int = 16, per_cluster: int = 250) -> DataFrame:
    """id, cluster_id, seed_count, cluster_rank, global_rank of what lies in the clusters of ``focus``.

    Clusters come by their focus points, then by the most references among them; within one, the
    most referenced and newest points not active yet come first.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    own = focus.filter(zero("cluster_id") > 0)
    clusters = own.groupBy("cluster_id").agg(F.count("*").alias("seed_count"), F.max(zero("paper_reference_count")).alias("most"))
    first = clusters.orderBy(F.desc("seed_count"), F.desc("most"), "cluster_id").limit(max(1, max_clusters))
    # At most max_clusters rows.
    near = universe.join(F.broadcast(first.drop("most")), "cluster_id").join(active.select("id"), "id", "left_anti")
    within = Window.partitionBy("cluster_id").orderBy(zero("paper_reference_count").desc(), zero("year").desc(), zero("point_index"), "id")
    ranked = near.withColumn("cluster_rank", F.row_number().over(within)).filter(F.col("cluster_rank") <= max(1, per_cluster))
    # At most max_clusters times per_cluster rows are ranked together.
    order = Window.orderBy(F.desc("seed_count"), "cluster_id", "cluster_rank", "id")
    found = ranked.select("id", "cluster_id", "seed_count", "cluster_rank").withColumn("global_rank", F.row_number().over(order))
    return found.filter(F.col("global_rank") <= max(1, max_points))


@dataclass(frozen=True)
class Overlay:
    """Ids by producer. Every change gives a new overlay; nothing is held in the session."""

    producers: dict[str, DataFrame] = field(default_factory=dict)

    def replace(self, producer: str, ids: DataFrame, universe: DataFrame, base: DataFrame) -> Overlay:
        """The producer's ids are those that the universe has and the base has not."""
        own = ids.select("id").distinct().join(universe.select("id"), "id", "left_semi").join(base.select("id"), "id", "left_anti")
        return Overlay({**self.producers, producer: own})

    def clear(self, producer: str) -> Overlay:
        return Overlay({p: ids for p, ids in self.producers.items() if p != producer})

    def clear_all(self) -> Overlay:
        return Overlay()

    def ids(self) -> DataFrame | None:
        """All producers' ids, each once."""
        found = None
        for ids in self.producers.values():
            found = ids if found is None else found.unionByName(ids)
        return None if found is None else found.distinct()


def reconciled(current: DataFrame, previous: DataFrame, following: DataFrame, others: DataFrame) -> DataFrame:
    """What one producer leaves shown: without what it showed before, with what follows, less what others show."""
    mine = current.join(previous, "id", "left_anti").unionByName(following)
    return mine.distinct().join(others, "id", "left_anti")
