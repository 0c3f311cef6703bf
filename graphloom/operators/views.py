"""Projections and joins over points, clusters, links and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.files import kept

COUNTS = ("paper_author_count", "paper_reference_count", "paper_entity_count", "paper_relation_count")


def cluster_label() -> Column:
    """The label of a cluster above 0, or a made-up one; null for noise."""
    number = F.coalesce("cluster_id", F.lit(0))
    made = F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))
    return F.when(number > 0, F.coalesce(F.nullif("cluster_label", F.lit("")), made))


def canvas(points: DataFrame) -> DataFrame:
    """What is drawn of a point: role, place, cluster, label and counts as doubles."""
    return points.select(
        "point_index", "id", "paper_id", F.lit("primary").alias("node_role"), "x", "y",
        F.coalesce("cluster_id", F.lit(0)).alias("cluster_id"), cluster_label().alias("cluster_label"),
        F.coalesce("display_label", "title", "citekey", "id").alias("display_label"), "title", "citekey", "journal", "year",
        *(F.col(c).cast("double").alias(c) for c in COUNTS),
    )


def query_view(points: DataFrame) -> DataFrame:
    """The canvas with what queries filter on besides."""
    return canvas_with(points, ["semantic_groups", "relation_categories", "text_availability", "is_in_base", "base_rank"])


def canvas_with(points: DataFrame, columns: list[str]) -> DataFrame:
    kept = [F.col(c).cast("double").alias(c) if c == "base_rank" else F.col(c) for c in columns]
    base = canvas(points).columns
    shaped = points.withColumns(
        {
            "node_role": F.lit("primary"),
            "display_label": F.coalesce("display_label", "title", "citekey", "id"),
            **{c: F.col(c).cast("double") for c in COUNTS},
        }
    ).withColumns({"cluster_label": cluster_label()})
    return shaped.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(0))).select(*base, *kept)


def cluster_view(clusters: DataFrame) -> DataFrame:
    """Clusters under their public names, with the columns that are not computed yet as nulls."""
    return clusters.select(
        F.col("cluster_id"), F.col("label").alias("cluster_label"), F.col("member_count"), F.col("centroid_x"), F.col("centroid_y"),
        *(F.lit(None).cast("int").alias(c) for c in ("entity_count", "relation_count")),
    )


def detail(points: DataFrame) -> DataFrame:
    """A point with whether it is there by an overlay only."""
    return points.withColumn("is_overlay_active", F.coalesce("node_role", F.lit("primary")) == "overlay")


def numbered(rows: DataFrame, order: list[Column], first: int, name: str) -> DataFrame:
    """``rows`` with gapless numbers from ``first`` in ``order``.

    Rows are range partitioned by the whole order and written with their place in the partition, then
    offset by the partitions before: no task sees all rows, and only one count of each meets in one.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = kept(ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_nth")), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    # One row for each partition.
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.lit(first) + F.col("_before") + F.col("_nth")).drop("_part", "_before", "_nth")


def overlay_points(universe: DataFrame, overlay_ids: DataFrame, base: DataFrame) -> DataFrame:
    """Points of the universe that an overlay asks for and the base lacks."""
    return universe.join(overlay_ids.select("id").distinct(), "id", "left_semi").join(base.select("id"), "id", "left_anti")


def active_points(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Base points, then overlay points with indices that go on where the base ends."""
    size = base.count()
    added = numbered(overlay.withColumnRenamed("point_index", "source_point_index"), [F.asc("source_point_index"), F.asc("id")], size, "point_index").withColumn("node_role", F.lit("overlay"))
    own = base.withColumn("node_role", F.lit("primary")).withColumn("source_point_index", F.col("point_index"))
    return own.unionByName(added.select(*own.columns))


def active_links(links: DataFrame, points: DataFrame) -> DataFrame:
    """Links with the indices of both ends; a link to a point that is not there goes."""
    ends = lambda side: points.select(F.col("id").alias(f"{side}_node_id"), F.col("point_index").alias(f"{side}_point_index"))
    bare = links.drop("source_point_index", "target_point_index")
    return bare.join(ends("source"), "source_node_id").join(ends("target"), "target_node_id")


def exemplars(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Exemplars with the paper of their point where they name none."""
    named = points.select(F.col("id").alias("node_id"), F.col("paper_id").alias("_of_point"), "title", "journal", "year")
    return rows.join(named, "node_id", "left").withColumn("paper_id", F.coalesce("paper_id", "_of_point")).drop("_of_point")


def paper_catalog(points: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each paper that a point or a document has: the point's values first.

    Rows without a paper id on either side make one row with a null id.
    """
    by_paper = points.groupBy("paper_id").agg(
        F.max("citekey").alias("p_citekey"), F.max("title").alias("p_title"), F.max("journal").alias("p_journal"), F.max("year").alias("p_year"),
        F.max("paper_author_count").alias("p_authors"), F.max("paper_reference_count").alias("p_references"),
        F.count("id").alias("points"), F.count_distinct(F.when(F.col("cluster_id") > 0, F.col("cluster_id"))).alias("clusters"),
    )
    by_document = documents.groupBy("paper_id").agg(*(F.max(c).alias(f"d_{c}") for c in documents.columns if c != "paper_id"), F.count("*").alias("copies"))
    both = by_paper.join(by_document, "paper_id", "full_outer")
    has = lambda c: f"d_{c}" in by_document.columns
    either = lambda p, d: F.coalesce(p, f"d_{d}") if has(d) else F.col(p)
    # A paper's rows are joined first and counted after, so each of its documents counts its points.
    rolled = both.select(
        "paper_id", either("p_citekey", "citekey").alias("citekey"), either("p_title", "title").alias("title"), either("p_journal", "journal").alias("journal"), either("p_year", "year").alias("year"),
        either("p_authors", "author_count").alias("author_count"), either("p_references", "reference_count").alias("reference_count"),
        (F.coalesce("points", F.lit(0)) * F.coalesce("copies", F.lit(1))).alias("graph_point_count"), F.coalesce("clusters", F.lit(0)).alias("graph_cluster_count"),
    )
    unmatched = rolled.filter(F.col("paper_id").isNull())
    return rolled.filter(F.col("paper_id").isNotNull()).unionByName(
        unmatched.groupBy("paper_id").agg(*(F.max(c).alias(c) for c in rolled.columns if not c.startswith(("paper_id", "graph_"))), F.sum("graph_point_count").alias("graph_point_count"), F.max("graph_cluster_count").alias("graph_cluster_count"))
    )


def with_attached(universe: DataFrame, attached: DataFrame, key: str = "id") -> DataFrame:
    """The universe with attached rows in place of rows of the same key."""
    return universe.join(attached.select(key), key, "left_anti").unionByName(attached)


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """How many ends of links each node has; 0 for one without any."""
    ends = links.select(F.col("source_node_id").alias("id")).unionByName(links.select(F.col("target_node_id").alias("id")))
    counted = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


PAPER_DETAIL = ("paper_id", "citekey", "title", "journal", "year", "author_count", "reference_count", "graph_point_count", "graph_cluster_count")


def paper_detail(catalog: DataFrame, paper: str) -> DataFrame:
    """What is shown of one paper; no row if the catalog lacks it."""
    return catalog.filter(F.col("paper_id") == paper).select(*PAPER_DETAIL).limit(1)


def selection_detail(point: DataFrame, clusters: DataFrame, exemplars: DataFrame, catalog: DataFrame, most: int = 5) -> DataFrame:
    """One row for each given point: its cluster, up to ``most`` exemplars of it by rank, and its paper (or itself), as structs.

    For a few points at a time: what a user selected.
    """
    few = point.select("id", "cluster_id", F.coalesce("paper_id", "id").alias("_paper"))
    rank = Window.partitionBy("cluster_id").orderBy("rank", "node_id")
    first = exemplars.join(few.select("cluster_id").distinct(), "cluster_id", "left_semi").withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= most)
    listed = first.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "node_id"))), lambda x: x["node_id"]).alias("exemplars"))
    cluster = clusters.select("cluster_id", F.struct(*clusters.columns).alias("cluster"))
    paper = catalog.select(F.col("paper_id").alias("_paper"), F.struct(*PAPER_DETAIL).alias("paper"))
    return few.join(cluster, "cluster_id", "left").join(listed, "cluster_id", "left").join(paper, "_paper", "left").select("id", "cluster", F.coalesce("exemplars", F.array().cast("array<string>")).alias("exemplars"), "paper")


def by_index(points: DataFrame, columns: list[str], index: str = "point_index") -> DataFrame:
    """Some columns of a release's points, in order of the index."""
    return points.select(index, *columns).orderBy(index)
