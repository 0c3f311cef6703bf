"""Groups in a graph of neighbours: communities, outliers, and the words that tell a group from others.

Edges are rows (id, other, ...); a node's edges are never brought together but as sums by community.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.analytics import column_quantiles
from graphloom.operators.retrieval import words
from graphloom.sources.files import kept

#: Levels of aggregation, rounds of moves and of refinement on a level, the share of moves below which a round is
#: quiet, and the gain in modularity below which levels end.
LEVELS, MOVES, REFINES, QUIET, LEAST_GAIN = 5, 10, 4, 0.005, 1e-3
#: Added to mean reachability, so that a density is finite.
TINY = 1e-10


def undirected(edges: DataFrame, weight: str = "score") -> DataFrame:
    """a, b, w in both directions, once for each pair: the greater weight of the two, and only those above 0."""
    once = edges.filter(F.col("id") != F.col("other")).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.col(weight).alias("w")).filter("w > 0").groupBy("a", "b").agg(F.max("w").alias("w"))
    return once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> float:
    """Newman's modularity of communities (id, community) over edges (a, b, w) that stand in both directions; a
    loop (a, a, w) stands once, with both its ends."""
    placed = edges.join(communities.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(communities.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    sums = placed.groupBy(F.col("ca").alias("c")).agg(F.sum("w").alias("all"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inner"))
    inner, squares, total = sums.agg(F.sum("inner"), F.sum(F.col("all") ** 2), F.sum("all")).first()
    return inner / total - resolution * squares / total**2 if total else 0.0


def _moved(edges: DataFrame, nodes: DataFrame, total: float, resolution: float, round_: int, within: bool) -> DataFrame:
    """nodes (id, k, community, bound) after one round of moves, with whether each moved.

    A node goes to the neighbouring community of greatest gain in modularity, the smaller id on ties; in a round a
    half of the nodes may, so that two neighbours seldom swap places for ever. ``within`` a bound, only single
    nodes join others of their bound.
    """
    turn = F.pmod(F.xxhash64("id", F.lit(round_)), F.lit(2)) == 0
    size = nodes.groupBy("community").agg(F.sum("k").alias("size"), F.count("*").alias("members"))
    # Nodes learn the size of their community, so that an edge brings it along. Edges of nodes that may not move now are not read further,
    # and the others are shuffled twice: to their far node, and back to the one that may move, whose sums then stay where they are.
    nodes = nodes.join(size, "community")
    other = nodes.select(F.col("id").alias("b"), F.col("community").alias("c"), F.col("size").alias("c_size"), F.col("bound").alias("b_bound"))
    heard = edges.filter((F.col("a") != F.col("b")) & (F.pmod(F.xxhash64("a", F.lit(round_)), F.lit(2)) == 0)).join(other, "b").select("a", "c", "c_size", "w", *(["b_bound"] if within else []))
    met = heard.repartition("a").join(nodes.select(F.col("id").alias("a"), "k", "community", "bound"), "a")
    if within:
        met = met.filter("bound = b_bound")
    links = met.groupBy("a", "k", "community", "c", "c_size").agg(F.sum("w").alias("w"))
    own: Column = F.when(F.col("c") == F.col("community"), F.col("k")).otherwise(0.0)
    gain = F.col("w") - F.lit(resolution / total) * F.col("k") * (F.col("c_size") - own)
    scored = links.select("a", "c", F.round(gain, 9).alias("gain"), (F.col("c") == F.col("community")).alias("stays"))
    best = scored.groupBy("a").agg(F.max(F.struct("gain", (-F.col("c")).alias("minus"))).alias("best"), F.max(F.when(F.col("stays"), F.col("gain"))).alias("kept"))
    told = nodes.join(best.withColumnRenamed("a", "id"), "id", "left")
    # Who has no edge into its own community loses nothing of it but its share of the sizes.
    stay = F.coalesce(F.col("kept"), F.round(-F.lit(resolution / total) * F.col("k") * (F.col("size") - F.col("k")), 9))
    goes = turn & F.col("best").isNotNull() & (F.col("best.gain") > stay) & (-F.col("best.minus") != F.col("community"))
    if within:
        goes = goes & (F.col("members") == 1) & (F.col("best.gain") > 0)
    goes = F.coalesce(goes, F.lit(False))
    return told.select("id", "k", F.when(goes, -F.col("best.minus")).otherwise(F.col("community")).alias("community"), "bound", goes.alias("moved"))


def _settled(edges: DataFrame, nodes: DataFrame, total: float, resolution: float, within: bool) -> DataFrame:
    """Rounds of moves until two in a row move few nodes."""
    quiet = 0
    for round_ in range(REFINES if within else MOVES):
        nodes = kept(_moved(edges, nodes.drop("moved"), total, resolution, round_, within), "moves")
        moved, count = nodes.agg(F.count_if("moved"), F.count("*")).first()
        quiet = quiet + 1 if moved <= QUIET * count else 0
        if quiet == 2:
            break
    return nodes.drop("moved")


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, community: each community of ``nodes`` split into its connected parts, named by their smallest id.

    The smallest id spreads along edges within a community, and to the node that the smallest known so far points
    at, so a chain is halved in each round.
    """
    inner = kept(edges.join(nodes.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(nodes.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b").filter("ca = cb and a <> b").select("a", "b"), "inner-edges")
    parts = kept(nodes.select("id", F.col("id").alias("part")), "parts")
    while True:
        heard = inner.join(parts.select(F.col("id").alias("b"), "part"), "b").groupBy(F.col("a").alias("id")).agg(F.min("part").alias("heard"))
        nearer = parts.join(heard, "id", "left").select("id", "part", F.least("part", F.coalesce("heard", "part")).alias("near"))
        jump = nearer.join(parts.select(F.col("id").alias("near"), F.col("part").alias("far")), "near").select("id", (F.least("near", "far") < F.col("part")).alias("changed"), F.least("near", "far").alias("part"))
        parts = kept(jump, "parts")
        if not parts.filter("changed").limit(1).count():
            return parts.select("id", F.col("part").alias("community"))
        parts = parts.drop("changed")


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """id, community of every node of undirected edges (a, b, w), by moves, refinement and aggregation (Leiden). A stored table.

    On each level nodes move to neighbouring communities; then, within each community, single nodes are merged
    anew, and what they form are the nodes of the next level, which start in the community they were refined from.
    So no community is held together by a node that has left it; at the end each is split into its connected parts.
    A community is named by its smallest node.
    """
    total = edges.agg(F.sum("w")).first()[0] or 0.0
    level, member = edges, kept(edges.select(F.col("a").alias("id")).distinct().withColumn("node", F.col("id")), "members")
    if not total:
        return member.select("id", F.col("node").alias("community"))
    best, nodes = float("-inf"), None
    for _ in range(LEVELS):
        degrees = level.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
        start = degrees.withColumn("community", F.col("id")) if nodes is None else degrees.join(nodes, "id")
        found = _settled(level, kept(start.withColumn("bound", F.lit(0).cast("long")), "nodes"), total, resolution, False)
        reached = modularity(level, found, resolution)
        if reached < best + LEAST_GAIN:
            break
        best = reached
        result = kept(member.join(found.select(F.col("id").alias("node"), "community"), "node").select("id", "community"), "communities")
        single = found.select("id", "k", F.col("id").alias("community"), F.col("community").alias("bound"))
        refined = _settled(level, single, total, resolution, True)
        # The refined groups become nodes; their edges add up, those within a group to a loop.
        group = refined.select("id", F.col("community").alias("group"), "bound")
        renamed = level.join(group.select(F.col("id").alias("a"), F.col("group").alias("ga")), "a").join(group.select(F.col("id").alias("b"), F.col("group").alias("gb")), "b")
        level = kept(renamed.groupBy(F.col("ga").alias("a"), F.col("gb").alias("b")).agg(F.sum("w").alias("w")), "level")
        member = kept(member.join(group.select(F.col("id").alias("node"), "group"), "node").select("id", F.col("group").alias("node")), "members")
        nodes = group.groupBy(F.col("group").alias("id")).agg(F.min("bound").alias("community"))
    return kept(connected(edges, result), "communities")


def outliers(neighbours: DataFrame, share: float = 0.02) -> DataFrame:
    """id, lof, is_outlier: how much thinner the neighbourhood of a row is than those of its neighbours.

    ``neighbours`` (id, other, distance) has each row's k nearest. The reach of a row from another is the
    distance, but at least that of the other's farthest neighbour; a density is one over the mean reach of the
    neighbours; the factor is the mean of their densities over the row's own. Outliers are rows beyond the quantile of factors that
    leaves this ``share``.
    """
    edges = kept(neighbours.select("id", "other", "distance"), "neighbours")
    widest = edges.groupBy(F.col("id").alias("other")).agg(F.max("distance").alias("width"))
    reach = edges.join(widest, "other").select("id", "other", F.greatest("distance", "width").alias("reach"))
    density = kept(reach.groupBy("id").agg((1 / (F.avg("reach") + TINY)).alias("density")), "densities")
    around = edges.join(density.select(F.col("id").alias("other"), F.col("density").alias("theirs")), "other").groupBy("id").agg(F.avg("theirs").alias("theirs"))
    factors = kept(around.join(density, "id").select("id", F.round(F.col("theirs") / F.col("density"), 6).alias("lof")), "factors")
    return factors.select("id", "lof", (F.col("lof") > F.lit(_quantile(factors, "lof", 1 - share))).alias("is_outlier"))


def _quantile(rows: DataFrame, column: str, share: float) -> float | None:
    """The exact, interpolated quantile of a column; no task ranks all its values."""
    found = column_quantiles(rows.select(F.lit(column).alias("column_key"), F.col(column).alias("value")), (share,)).first()
    return found["quantiles"][0] if found else None


def beyond(points: DataFrame, x: str, y: str, percentile: float = 99.0, key: str = "id") -> DataFrame:
    """key, radius, is_beyond: points farther from the mean point than this percentile of all distances."""
    centre = points.agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    dx, dy = F.col(x) - F.col("cx"), F.col(y) - F.col("cy")
    far = kept(points.crossJoin(F.broadcast(centre)).select(key, F.round(F.sqrt(dx * dx + dy * dy), 3).alias("radius")), "radii")
    return far.withColumn("is_beyond", F.col("radius") > F.lit(_quantile(far, "radius", percentile / 100)))


def cluster_labels(texts: DataFrame, cluster: str, text: str = "text", k: int = 10) -> DataFrame:
    """cluster, term, weight, rank: the k words that tell each cluster from the others (class-based TF-IDF).

    A cluster's texts count as one document: a word's share of its words, times ln(1 + mean words of a cluster over the word's
    count in all of them). Words are counted within a text before anything is shuffled, and a task keeps its own first k.
    """
    held = texts.filter(F.col(cluster).isNotNull()).select(F.col(cluster).alias("cluster"), F.explode(words(F.coalesce(text, F.lit("")))).alias("term"))
    counts = kept(held.groupBy("cluster", "term").agg(F.count("*").alias("n")), "class-terms")
    sizes = counts.groupBy("cluster").agg(F.sum("n").alias("size"))
    mean = sizes.agg(F.avg("size").alias("mean"))
    everywhere = counts.groupBy("term").agg(F.sum("n").alias("total"))
    weight = F.round(F.col("n") / F.col("size") * F.log1p(F.col("mean") / F.col("total")), 9)
    weighed = counts.join(everywhere, "term").join(sizes, "cluster").crossJoin(F.broadcast(mean)).select("cluster", "term", weight.alias("weight"))
    order = Window.partitionBy("cluster").orderBy(F.desc("weight"), "term")
    return weighed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
