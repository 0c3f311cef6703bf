"""Queries over points, clusters, links and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.codes import palette_colour
from graphloom.operators import analytics, guard, insights, overlay, scope, views
from graphloom.plans.base import REGISTERED, query
from graphloom.plans.standins import LINKS, POINTS, links, points, with_
from graphloom.sources import files
from graphloom.sources.files import table

NUMERIC = ["x", "y", "year", "paper_reference_count"]


def _selection() -> scope.Selection:
    return scope.Selection((scope.Clause("filter:journal", scope.is_value("journal", "BUILDING")), scope.Clause("timeline:year", scope.within("year", 1993, 1998)), scope.Clause("lasso", F.col("x") > 0)))


SCOPED = "scoped AS (SELECT * FROM points WHERE journal = 'BUILDING' AND year BETWEEN 1993 AND 1998)"
SELECTED = "selected AS (SELECT * FROM points WHERE x > 5000)"


def _scoped(p: DataFrame) -> DataFrame:
    return scope.scoped(p, "current", _selection())


def _selected(p: DataFrame) -> DataFrame:
    return scope.scoped(p, "selected", selected=p.filter("x > 5000").select("point_index"))


@query(with_(POINTS) + "SELECT point_index, id, paper_id, x, y FROM points")
def src_01(spark: SparkSession, sf: str) -> DataFrame:
    """Scan with the wanted columns only."""
    return points(spark, sf).select("point_index", "id", "paper_id", "x", "y")


@query("SELECT count(*) AS n, count(DISTINCT label) AS labels FROM embeddings")
def src_02(spark: SparkSession, sf: str) -> DataFrame:
    """A table that is read when it is asked for."""
    bundle = files.Bundle(spark, sf, {"tables": {"embeddings": {"file": "embeddings.parquet"}}})
    return bundle.table("embeddings", ["label"]).agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"))


@query(with_(POINTS) + "SELECT id, journal FROM points WHERE NOT (x > 9000) UNION ALL SELECT id, 'fetched' AS journal FROM points WHERE x > 9000")
def src_05(spark: SparkSession, sf: str) -> DataFrame:
    """Attached rows in place of stored ones."""
    p = points(spark, sf).select("id", "journal", "x")
    stage = p.filter("x > 9000").withColumn("journal", F.lit("fetched"))
    return views.with_attached(p, stage).select("id", "journal")


@query(with_(POINTS) + "SELECT point_index, id FROM points WHERE paper_id IS NOT NULL ORDER BY md5(id || '|7'), id LIMIT 100")
def src_21(spark: SparkSession, sf: str) -> DataFrame:
    """A sample that is the same for a seed."""
    return analytics.sample(points(spark, sf), 100, 7).select("point_index", "id")


@query(with_(POINTS) + """SELECT point_index, id, paper_id, node_role, x, y, coalesce(cluster_id, 0) AS cluster_id,
  CASE WHEN coalesce(cluster_id, 0) > 0 THEN coalesce(nullif(cluster_label, ''), 'Cluster ' || cluster_id) END AS cluster_label,
  coalesce(display_label, title, citekey, id) AS display_label, title, citekey, journal, year, paper_author_count::DOUBLE AS paper_author_count, paper_reference_count::DOUBLE AS paper_reference_count,
  paper_entity_count::DOUBLE AS paper_entity_count, paper_relation_count::DOUBLE AS paper_relation_count FROM points""")  # fmt: skip
def prj_01(spark: SparkSession, sf: str) -> DataFrame:
    """What is drawn of a point."""
    return views.canvas(points(spark, sf))


@query(with_(POINTS) + "SELECT point_index, id, coalesce(display_label, title, citekey, id) AS display_label, semantic_groups, relation_categories, text_availability, is_in_base, base_rank::DOUBLE AS base_rank FROM points")
def prj_02(spark: SparkSession, sf: str) -> DataFrame:
    """What queries filter on."""
    return views.query_view(points(spark, sf)).select("point_index", "id", "display_label", "semantic_groups", "relation_categories", "text_availability", "is_in_base", "base_rank")


@query(with_(POINTS) + "SELECT DISTINCT cluster_id, CASE WHEN coalesce(cluster_id, 0) > 0 THEN coalesce(nullif(cluster_label, ''), 'Cluster ' || cluster_id) END AS cluster_label FROM points")
def prj_03(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of clusters, made up where there is none."""
    return points(spark, sf).select("cluster_id", views.cluster_label().alias("cluster_label")).distinct()


@query(with_(POINTS) + "SELECT id, point_index AS paper_index, 'overlay' AS node_role FROM points WHERE NOT is_in_base")
def prj_04(spark: SparkSession, sf: str) -> DataFrame:
    """Columns replaced, renamed and dropped."""
    return points(spark, sf).filter("not is_in_base").withColumn("node_role", F.lit("overlay")).withColumnRenamed("point_index", "paper_index").select("id", "paper_index", "node_role")


CLUSTERS = "clusters AS (SELECT cluster_id, max(cluster_label) AS label, count(*) AS member_count, round(avg(x), 4) AS centroid_x, round(avg(y), 2) AS centroid_y FROM points GROUP BY cluster_id)"


def _clusters(p: DataFrame) -> DataFrame:
    return p.groupBy("cluster_id").agg(F.max("cluster_label").alias("label"), F.count("*").alias("member_count"), F.round(F.avg("x"), 4).alias("centroid_x"), F.round(F.avg("y"), 2).alias("centroid_y"))


@query(with_(POINTS, CLUSTERS) + "SELECT cluster_id, label AS cluster_label, member_count, centroid_x, centroid_y, NULL::BIGINT AS entity_count, NULL::BIGINT AS relation_count FROM clusters")
def prj_05(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters with columns that are not computed yet."""
    return views.cluster_view(_clusters(points(spark, sf)))


@query(with_(POINTS) + "SELECT id, node_role, coalesce(node_role, 'primary') = 'overlay' AS is_overlay_active, title, citekey, journal, year FROM points")
def prj_06(spark: SparkSession, sf: str) -> DataFrame:
    """A point's details."""
    return views.detail(points(spark, sf)).select("id", "node_role", "is_overlay_active", "title", "citekey", "journal", "year")


@query(with_(POINTS, SELECTED) + "SELECT point_index, id FROM selected")
def flt_01(spark: SparkSession, sf: str) -> DataFrame:
    """The selected points."""
    return _selected(points(spark, sf)).select("point_index", "id")


@query(with_(POINTS) + """SELECT id FROM points WHERE list_contains(string_split_regex(semantic_groups, '\\s*,\\s*'), '1-URGENT') AND year IS NULL OR journal = 'MACHINERY'""")
def flt_02(spark: SparkSession, sf: str) -> DataFrame:
    """Values, missing values and members of multiple values."""
    wanted = scope.is_value("semantic_groups", "1-URGENT", multiple=True) & scope.is_value("year", "null") | scope.is_value("journal", "MACHINERY")
    return points(spark, sf).filter(wanted).select("id")


@query(with_(POINTS) + "SELECT id, x FROM points WHERE x BETWEEN -100.5 AND 2500")
def flt_03(spark: SparkSession, sf: str) -> DataFrame:
    """A range, both ends included."""
    return points(spark, sf).filter(scope.within("x", -100.5, 2500)).select("id", "x")


@query(with_(POINTS) + "SELECT id FROM points WHERE point_index = 5 OR cluster_id = 3 OR (x BETWEEN 0 AND 1000 AND y BETWEEN 0 AND 1000000)")
def flt_04(spark: SparkSession, sf: str) -> DataFrame:
    """A seed with its cluster and its surroundings."""
    return points(spark, sf).filter(scope.focus(5, 3, (0, 1000, 0, 1000000))).select("id")


@query(with_(POINTS) + "SELECT journal, count(*) AS count FROM points WHERE year BETWEEN 1993 AND 1998 GROUP BY journal")
def flt_06(spark: SparkSession, sf: str) -> DataFrame:
    """A crossfilter: a widget's counts leave its own filter out."""
    return scope.scoped(points(spark, sf), "current", _selection(), without="filter:journal").groupBy("journal").agg(F.count("*").alias("count"))


@query(with_(POINTS, SCOPED) + "SELECT id FROM scoped WHERE x > 5000")
def flt_07(spark: SparkSession, sf: str) -> DataFrame:
    """What is visible of a locked selection."""
    p = points(spark, sf)
    locked = scope.Selection(_selection().clauses, p.filter("x > 5000").select("point_index"), True)
    return scope.scoped(p, "current", locked).select("id")


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def flt_09(spark: SparkSession, sf: str) -> DataFrame:
    """A user's read-only SQL."""
    table(spark, sf, "customer").createOrReplaceTempView("guarded_customer")
    return guard.run(spark, "SELECT c_mktsegment, count(*) AS n FROM guarded_customer GROUP BY c_mktsegment;")


@query(with_(POINTS) + "SELECT id, year FROM points WHERE year IS NULL OR year >= 1995")
def flt_12(spark: SparkSession, sf: str) -> DataFrame:
    """A year floor that lets missing years pass."""
    return points(spark, sf).filter(scope.year_from("year", 1995)).select("id", "year")


@query(with_(POINTS) + "SELECT id FROM points WHERE journal IS DISTINCT FROM 'BUILDING' AND year IS DISTINCT FROM 1992")
def flt_14(spark: SparkSession, sf: str) -> DataFrame:
    """Differences in which nulls are values."""
    return points(spark, sf).filter(~F.col("journal").eqNullSafe("BUILDING") & ~F.col("year").eqNullSafe(1992)).select("id")


@query(with_(POINTS) + "SELECT id FROM points WHERE year BETWEEN 1993 AND 1995 AND journal IN ('BUILDING', 'FURNITURE') AND list_has_any(string_split(semantic_groups, ', '), ['1-URGENT', '2-HIGH'])")
def flt_17(spark: SparkSession, sf: str) -> DataFrame:
    """The limits of a retrieval."""
    p = points(spark, sf).withColumn("concepts", F.split("semantic_groups", ", "))
    return p.filter(scope.retrieval_filter((1993, 1995), ["BUILDING", "FURNITURE"], ["1-URGENT", "2-HIGH"])).select("id")


@query(with_(POINTS, LINKS) + """SELECT link_id, source_node_id, target_node_id, s.point_index AS source_point_index, t.point_index AS target_point_index
FROM links JOIN points s ON s.id = source_node_id JOIN points t ON t.id = target_node_id WHERE link_kind = 'citation'""")
def jon_01(spark: SparkSession, sf: str) -> DataFrame:
    """Links with the indices of both ends."""
    found = views.active_links(links(spark, sf).filter("link_kind = 'citation'"), points(spark, sf))
    return found.select("link_id", "source_node_id", "target_node_id", "source_point_index", "target_point_index")


@query(with_(POINTS) + "SELECT id FROM points WHERE NOT is_in_base AND year >= 1993")
def jon_02(spark: SparkSession, sf: str) -> DataFrame:
    """Points that an overlay asks for and the base lacks."""
    p = points(spark, sf)
    return views.overlay_points(p, p.filter("year >= 1993").select("id"), p.filter("is_in_base")).select("id")


EXEMPLARS = "exemplars AS (SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY x DESC, point_index) AS rank, id AS node_id, CASE WHEN year > 1993 THEN 'own' || point_index END AS paper_id, x AS exemplar_score FROM points)"


def _exemplars(p: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("x"), "point_index"))
    return p.select("cluster_id", rank.alias("rank"), F.col("id").alias("node_id"), F.when(F.col("year") > 1993, F.concat(F.lit("own"), "point_index")).alias("paper_id"), F.col("x").alias("exemplar_score"))


@query(with_(POINTS, EXEMPLARS) + "SELECT e.cluster_id, rank, node_id, coalesce(e.paper_id, p.paper_id) AS paper_id, title FROM exemplars e LEFT JOIN points p ON p.id = node_id WHERE rank <= 5")
def jon_03(spark: SparkSession, sf: str) -> DataFrame:
    """Exemplars with the papers of their points."""
    p = points(spark, sf)
    return views.exemplars(_exemplars(p).filter("rank <= 5"), p).select("cluster_id", "rank", "node_id", "paper_id", "title")


DOCUMENTS = "docs AS (SELECT 'P' || (doc_id % 700) AS paper_id, lang AS citekey, 'd' || doc_id AS title, source AS journal, n_chars AS reference_count FROM documents)"


@query(with_(POINTS, DOCUMENTS) + """SELECT coalesce(p.paper_id, d.paper_id) AS paper_id, coalesce(max(p.citekey), max(d.citekey)) AS citekey, coalesce(max(p.title), max(d.title)) AS title,
  coalesce(max(p.paper_reference_count), max(d.reference_count)) AS reference_count, count(*) FILTER (WHERE p.id IS NOT NULL) AS graph_point_count, count(DISTINCT CASE WHEN p.cluster_id > 0 THEN p.cluster_id END) AS graph_cluster_count
FROM points p FULL OUTER JOIN docs d ON p.paper_id = d.paper_id GROUP BY 1""")  # fmt: skip
def jon_04(spark: SparkSession, sf: str) -> DataFrame:
    """Papers that a point or a document has."""
    d = table(spark, sf, "documents").select(F.concat(F.lit("P"), (F.col("doc_id") % 700).cast("string")).alias("paper_id"), F.col("lang").alias("citekey"), F.concat(F.lit("d"), "doc_id").alias("title"), F.col("source").alias("journal"), F.col("n_chars").alias("reference_count"))
    return views.paper_catalog(points(spark, sf), d).select("paper_id", "citekey", "title", "reference_count", "graph_point_count", "graph_cluster_count")


@query(with_(POINTS) + """, wanted AS (SELECT 'C' || (o_orderkey % 2000) AS id FROM orders GROUP BY 1)
SELECT w.id, CASE WHEN p.is_in_base THEN 'base' WHEN p.id IS NOT NULL THEN 'universe' ELSE 'missing' END AS store FROM wanted w LEFT JOIN points p ON p.id = w.id""")
def jon_25(spark: SparkSession, sf: str) -> DataFrame:
    """Where each wanted id is found first."""
    p = points(spark, sf)
    wanted = table(spark, sf, "orders").select(F.concat(F.lit("C"), (F.col("o_orderkey") % 2000).cast("string")).alias("id"))
    return scope.availability(wanted, ("base", p.filter("is_in_base")), ("universe", p))


@query(with_(POINTS, SCOPED) + """SELECT (SELECT count(*) FROM points) AS total_count, count(*) AS scoped_count, count(*) FILTER (WHERE node_role <> 'overlay') AS base_count, count(*) FILTER (WHERE node_role = 'overlay') AS overlay_count,
  count(DISTINCT nullif(paper_id, '')) AS paper_count, count(DISTINCT CASE WHEN cluster_id > 0 THEN cluster_id END) AS cluster_count, count(*) FILTER (WHERE coalesce(cluster_id, 0) <= 0) AS noise_count,
  min(year) AS min_year, max(year) AS max_year, count(*) < (SELECT count(*) FROM points) AS is_subset FROM scoped""")  # fmt: skip
def agg_01(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of what is visible."""
    p = points(spark, sf)
    return analytics.summary(_scoped(p), table(spark, sf, "customer").count())


@query(with_(POINTS, SCOPED) + "SELECT cluster_id, max(cluster_label) AS cluster_label, count(*) AS count FROM scoped WHERE coalesce(cluster_id, 0) > 0 GROUP BY cluster_id ORDER BY count DESC, cluster_id LIMIT 8")
def agg_01_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Its largest clusters."""
    return analytics.top_clusters(_scoped(points(spark, sf)))


@query(with_(POINTS, SCOPED) + "SELECT 'semantic_groups' AS column_key, value, count, row_number() OVER (ORDER BY count DESC, value) AS row_rank FROM (SELECT semantic_groups AS value, count(*) AS count FROM scoped WHERE semantic_groups <> '' GROUP BY semantic_groups) QUALIFY row_rank <= 8")
def agg_02(spark: SparkSession, sf: str) -> DataFrame:
    """Value counts of one column; multiple values stay whole."""
    return analytics.value_counts(_scoped(points(spark, sf)), ["semantic_groups"], 8)


COUNTS = """values_ AS (
  SELECT 'journal' AS column_key, journal AS value FROM {t} UNION ALL SELECT 'year', year::VARCHAR FROM {t} UNION ALL SELECT 'text_availability', text_availability FROM {t}
  UNION ALL SELECT 'semantic_groups', trim(v) FROM {t}, UNNEST(string_split_regex(semantic_groups, '\\s*,\\s*')) AS s(v)),
tallies AS (SELECT column_key, value, count(*) AS count FROM values_ WHERE value <> '' GROUP BY column_key, value),
counts AS (SELECT *, row_number() OVER (PARTITION BY column_key ORDER BY count DESC, value) AS row_rank FROM tallies)"""
FACETED = ["journal", "year", "text_availability", "semantic_groups"]


@query(with_(POINTS, SCOPED, COUNTS.format(t="scoped")) + "SELECT * FROM counts WHERE row_rank <= 5")
def agg_03(spark: SparkSession, sf: str) -> DataFrame:
    """Value counts of several columns in one scan."""
    return analytics.value_counts(_scoped(points(spark, sf)), FACETED, 5, ["semantic_groups"])


FACETS = (
    with_(POINTS, SELECTED)
    + ", "
    + COUNTS.format(t="points").replace("values_", "all_values").replace("tallies", "all_tallies").replace("counts AS", "all_counts AS")
    + ", "
    + COUNTS.format(t="selected")
    + """, merged AS (
  SELECT coalesce(s.column_key, a.column_key) AS column_key, coalesce(s.value, a.value) AS value, coalesce(s.count, 0) AS scoped_count, coalesce(a.count, 0) AS total_count, s.count IS NULL AS only_all
  FROM (SELECT * FROM counts WHERE row_rank <= {n} * {deep}) s FULL OUTER JOIN (SELECT * FROM all_counts WHERE row_rank <= {n} * {deep}) a ON s.column_key = a.column_key AND s.value = a.value)
SELECT column_key, value, scoped_count, total_count, row_number() OVER (PARTITION BY column_key ORDER BY only_all, scoped_count DESC, CASE WHEN only_all THEN total_count END DESC, value) AS row_rank
FROM merged QUALIFY row_rank <= {n}"""
)


@query(FACETS.replace("{n}", "3").replace("{deep}", "4"))
def agg_04(spark: SparkSession, sf: str) -> DataFrame:
    """Facets of the selection against the dataset."""
    p = points(spark, sf)
    return analytics.facets(p, _selected(p), FACETED, 3, ["semantic_groups"])


@query(FACETS.replace("{n}", "6").replace("{deep}", "4"))
def agg_06(spark: SparkSession, sf: str) -> DataFrame:
    """Facets at the depth of a session."""
    p = points(spark, sf)
    return analytics.session_facets(p, _selected(p), FACETED, 6, ["semantic_groups"])


def _bins(source: str, bins: int, low: str, high: str) -> str:
    columns = " UNION ALL ".join(f"SELECT '{c}' AS column_key, {c}::DOUBLE AS value FROM {source} WHERE {c} IS NOT NULL" for c in NUMERIC)
    return f"""numbers AS ({columns}),
  bounds AS (SELECT column_key, {low} AS low, {high} AS high, count(*) AS total_count FROM numbers GROUP BY column_key),
  binned AS (SELECT column_key, low, high, total_count, CASE WHEN low = high THEN 0 ELSE least(greatest(floor((least(greatest(value, low), high) - low) / ((high - low) / {bins})), 0), {bins - 1}) END::BIGINT AS bin FROM numbers JOIN bounds USING (column_key)),
  bins AS (SELECT column_key, bin, CASE WHEN low = high THEN low ELSE low + (high - low) / {bins} * bin END AS bin_min, CASE WHEN low = high THEN high ELSE low + (high - low) / {bins} * (bin + 1) END AS bin_max, count(*) AS count, total_count FROM binned GROUP BY ALL)"""


ROUNDED = "SELECT column_key, bin, round(bin_min, 6) AS bin_min, round(bin_max, 6) AS bin_max, count, total_count FROM bins"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


@query(with_(POINTS, SCOPED, _bins("scoped", 16, "min(value)", "max(value)")) + ROUNDED)
def agg_07(spark: SparkSession, sf: str) -> DataFrame:
    """Histograms of several columns."""
    return _rounded(analytics.histogram(_scoped(points(spark, sf)), NUMERIC))


@query(with_(POINTS, _bins("points", 20, "quantile_cont(value, 0.05)", "quantile_cont(value, 0.95)")) + ROUNDED)
def agg_07_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Histograms between quantiles; values outside go to the first and last bin."""
    return _rounded(analytics.histogram(points(spark, sf), NUMERIC, 20, quantiles=True))


@query(with_(POINTS, _bins("points", 10, "CASE WHEN column_key = 'year' THEN 1990.0 ELSE 0.0 END", "CASE WHEN column_key = 'year' THEN 2000.0 ELSE 10000.0 END")) + ROUNDED)
def agg_07_extents(spark: SparkSession, sf: str) -> DataFrame:
    """Histograms in stated extents."""
    return _rounded(analytics.histogram(points(spark, sf), NUMERIC, 10, extent=(0, 10000), extents={"year": (1990, 2000)}))


STATS = "stats AS (SELECT column_key, min(value) AS min_value, quantile_cont(value, 0.5) AS median_value, avg(value) AS avg_value, max(value) AS max_value FROM numbers GROUP BY column_key)"


@query(with_(POINTS, _bins("points", 16, "min(value)", "max(value)"), STATS) + "SELECT column_key, round(min_value, 4) AS min_value, round(median_value, 4) AS median_value, round(avg_value, 4) AS avg_value, round(max_value, 4) AS max_value FROM stats")
def agg_09(spark: SparkSession, sf: str) -> DataFrame:
    """Least, median, mean and greatest of several columns."""
    df = analytics.numeric_stats(points(spark, sf), NUMERIC)
    return df.select("column_key", *(F.round(c, 4).alias(c) for c in df.columns[1:]))


@query(with_(POINTS, SCOPED) + "SELECT min(x) AS x_min, min(y) AS y_min, CASE WHEN min(x) = max(x) THEN max(x) + 1e-6 ELSE max(x) END AS x_max, CASE WHEN min(y) = max(y) THEN max(y) + 1e-6 ELSE max(y) END AS y_max FROM scoped")
def agg_10(spark: SparkSession, sf: str) -> DataFrame:
    """The box around what is visible."""
    return analytics.bounding_box(_scoped(points(spark, sf)))


@query(with_(POINTS, SCOPED) + """, seed AS (SELECT point_index AS seed_index, x, y, CASE WHEN coalesce(cluster_id, 0) > 0 THEN cluster_id END AS cid FROM points WHERE id = 'C8'),
e AS (SELECT max(x) - min(x) AS sx, max(y) - min(y) AS sy FROM scoped), c AS (SELECT count(*) AS n, max(s.x) - min(s.x) AS cx, max(s.y) - min(s.y) AS cy FROM scoped s, seed WHERE s.cluster_id = seed.cid),
pads AS (SELECT *, least(greatest(coalesce(cx * CASE WHEN n > 4000 THEN 0.12 ELSE 0.18 END, sx * 0.02, 0.001), coalesce(sx * 0.01, 0.001), 0.001), greatest(coalesce(sx * 0.08, 0.02), 0.02)) AS px,
  least(greatest(coalesce(cy * CASE WHEN n > 4000 THEN 0.12 ELSE 0.18 END, sy * 0.02, 0.001), coalesce(sy * 0.01, 0.001), 0.001), greatest(coalesce(sy * 0.08, 0.02), 0.02)) AS py FROM seed, e, c)
SELECT seed_index, CASE WHEN n > 0 THEN cid END AS cluster_id, cid IS NOT NULL AND n BETWEEN 1 AND 4000 AS include_cluster, round(x - px, 4) AS x_min, round(x + px, 4) AS x_max, round(y - py, 4) AS y_min, round(y + py, 4) AS y_max FROM pads""")  # fmt: skip
def agg_11(spark: SparkSession, sf: str) -> DataFrame:
    """A seed's surroundings as its cluster and the scope size them."""
    p = points(spark, sf)
    df = analytics.visibility_budget(p, _scoped(p), F.col("id") == "C8")
    return df.withColumns({c: F.round(c, 4) for c in ("x_min", "x_max", "y_min", "y_max")})


@query(with_(POINTS, SCOPED) + "SELECT DISTINCT trim(coalesce(paper_id, id)) AS ref FROM scoped WHERE trim(coalesce(paper_id, id)) <> ''")
def agg_13(spark: SparkSession, sf: str) -> DataFrame:
    """The papers of a scope."""
    return analytics.paper_refs(_scoped(points(spark, sf)))


@query(with_(POINTS, SCOPED, _bins("scoped", 16, "min(value)", "max(value)")) + "SELECT column_key, bin, round((bin_min + bin_max) / 2, 4) AS midpoint, count, round(count / total_count, 6) AS fraction FROM bins QUALIFY row_number() OVER (PARTITION BY column_key ORDER BY count DESC, bin) = 1")
def anl_01(spark: SparkSession, sf: str) -> DataFrame:
    """The fullest bin of each column."""
    df = insights.peak_bins(analytics.histogram(_scoped(points(spark, sf)), NUMERIC))
    return df.withColumns({"midpoint": F.round("midpoint", 4), "fraction": F.round("fraction", 6)})


@query(with_(POINTS, _bins("points", 16, "min(value)", "max(value)"), STATS) + """, m AS (SELECT column_key, sum(count * (bin_min + bin_max) / 2) / max(total_count) AS mean, count(*) AS n_bins FROM bins GROUP BY 1),
k AS (SELECT column_key, n_bins, median_value, avg_value, sum(count * pow((bin_min + bin_max) / 2 - avg_value, 2)) / max(total_count) AS v, sum(count * pow((bin_min + bin_max) / 2 - mean, 2)) / max(total_count) AS m2, sum(count * pow((bin_min + bin_max) / 2 - mean, 3)) / max(total_count) AS m3
  FROM bins JOIN m USING (column_key) JOIN stats USING (column_key) GROUP BY ALL),
s AS (SELECT column_key, CASE WHEN avg_value <> median_value THEN CASE WHEN v > 0 THEN 3 * (avg_value - median_value) / sqrt(v) ELSE 0 END ELSE CASE WHEN m2 > 0 THEN m3 / pow(sqrt(m2), 3) ELSE 0 END END AS skew FROM k WHERE n_bins >= 3)
SELECT column_key, round(skew, 6) AS skew, CASE WHEN abs(skew) < 0.15 THEN 'symmetric' WHEN skew > 0 THEN 'right-skewed' ELSE 'left-skewed' END AS direction FROM s""")  # fmt: skip
def anl_02(spark: SparkSession, sf: str) -> DataFrame:
    """How skewed each column is."""
    p = points(spark, sf)
    df = insights.shapes(analytics.histogram(p, NUMERIC), analytics.numeric_stats(p, NUMERIC))
    return df.withColumn("skew", F.round("skew", 6))


@query(with_(POINTS, _bins("points", 16, "min(value)", "max(value)")) + """SELECT column_key, round(sum(count) FILTER (WHERE r <= 3) / sum(count), 6) AS top_fraction, least(count(*), 3) AS n FROM (SELECT *, row_number() OVER (PARTITION BY column_key ORDER BY count DESC, bin) AS r FROM bins) GROUP BY column_key""")
def anl_03(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each column its three fullest bins hold."""
    df = insights.concentration(analytics.histogram(points(spark, sf), NUMERIC), [F.desc("count"), F.asc("bin")])
    return df.withColumn("top_fraction", F.round("top_fraction", 6))


@query(with_(POINTS, COUNTS.format(t="points")) + """SELECT column_key, count(*) AS unique_count, CASE WHEN count(*) > 1 THEN round(-sum(p * ln(p)) / ln(count(*)), 6) END AS normalized_entropy
FROM (SELECT column_key, count / sum(count) OVER (PARTITION BY column_key) AS p FROM counts) GROUP BY column_key""")
def anl_04(spark: SparkSession, sf: str) -> DataFrame:
    """How diverse each column's values are."""
    counts = analytics.all_value_counts(points(spark, sf), FACETED, ["semantic_groups"])
    df = insights.diversity(counts)
    return df.withColumn("normalized_entropy", F.round("normalized_entropy", 6))


@query(with_(POINTS, COUNTS.format(t="points")) + "SELECT column_key, min_by(value, row_rank) AS value, max(count) AS count, round(max(count) / sum(count), 6) AS fraction FROM counts GROUP BY column_key")
def anl_05(spark: SparkSession, sf: str) -> DataFrame:
    """Each column's most frequent value."""
    df = insights.dominant(analytics.all_value_counts(points(spark, sf), FACETED, ["semantic_groups"]))
    return df.withColumn("fraction", F.round("fraction", 6))


@query(with_(POINTS, _bins("points", 16, "min(value)", "max(value)"), STATS) + "SELECT column_key, round(CASE WHEN max_value <> min_value AND median_value <> 0 THEN (max_value - min_value) / abs(median_value) END, 6) AS relative_range FROM stats")
def anl_06(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges over medians."""
    return _rounded(insights.spread(analytics.numeric_stats(points(spark, sf), NUMERIC)))


def _stats_of(source: str, name: str) -> str:
    return _bins(source, 16, "min(value)", "max(value)").split("bounds AS")[0].rstrip(", \n").replace("numbers AS", f"n_{name} AS") + ", " + STATS.replace("numbers", f"n_{name}").replace("stats AS", f"s_{name} AS")


@query(with_(POINTS, SELECTED, _stats_of("points", "all"), _stats_of("selected", "own")) + """SELECT column_key, round(o.median_value - d.median_value, 4) AS median_delta, round((o.median_value - d.median_value) / nullif(abs(d.median_value), 0), 4) AS median_relative_change,
round(o.avg_value - d.avg_value, 4) AS avg_delta, round((o.avg_value - d.avg_value) / nullif(abs(d.avg_value), 0), 4) AS avg_relative_change FROM s_all d JOIN s_own o USING (column_key)""")  # fmt: skip
def anl_07(spark: SparkSession, sf: str) -> DataFrame:
    """What the selection shifts."""
    p = points(spark, sf)
    df = insights.shift(analytics.numeric_stats(p, NUMERIC), analytics.numeric_stats(_selected(p), NUMERIC))
    return df.select("column_key", *(F.round(c, 4).alias(c) for c in df.columns[1:]))


def _part(name: str) -> str:
    return f"({REGISTERED[name][1]})"


@query(f"""SELECT column_key, p.bin AS peak_bin, direction, top_fraction, relative_range FROM ({with_(POINTS, _bins("points", 16, "min(value)", "max(value)"))} SELECT column_key, bin FROM bins QUALIFY row_number() OVER (PARTITION BY column_key ORDER BY count DESC, bin) = 1) p LEFT JOIN {_part("anl_02")} USING (column_key) LEFT JOIN {_part("anl_03")} USING (column_key) LEFT JOIN {_part("anl_06")} USING (column_key)""")
def anl_08(spark: SparkSession, sf: str) -> DataFrame:
    """All insights into each numeric column."""
    p = points(spark, sf)
    df = insights.column_insights(analytics.histogram(p, NUMERIC), analytics.numeric_stats(p, NUMERIC))
    return df.select("column_key", F.col("peak.bin").alias("peak_bin"), F.col("shape.direction").alias("direction"), F.round("top_fraction", 6).alias("top_fraction"), F.round("relative_range", 6).alias("relative_range"))


@query(with_(POINTS, SCOPED, SELECTED) + """, a AS (SELECT journal AS value, count(*) AS c FROM points GROUP BY 1), o AS (SELECT journal AS value, count(*) AS c FROM selected GROUP BY 1), f AS (SELECT journal AS value, count(*) AS c FROM scoped GROUP BY 1)
SELECT a.value, a.c AS total_count, o.c AS selection_count, f.c AS filtered_count, round((o.c / (SELECT sum(c) FROM o)) / (a.c / (SELECT sum(c) FROM a)), 6) AS enrichment
FROM a LEFT JOIN o USING (value) LEFT JOIN f USING (value) ORDER BY coalesce(f.c, o.c, a.c) DESC, a.c DESC, a.value LIMIT 4""")  # fmt: skip
def anl_09(spark: SparkSession, sf: str) -> DataFrame:
    """How much more frequent values are in the selection."""
    p = points(spark, sf)
    counted = lambda df: df.groupBy(F.col("journal").alias("value")).agg(F.count("*").alias("count"))
    return _rounded(insights.enrichment(counted(p), counted(_selected(p)), counted(_scoped(p)), 4))


def _overlaid(p: DataFrame) -> DataFrame:
    base = p.filter("is_in_base")
    return views.active_points(base, views.overlay_points(p, p.filter("year >= 1993").select("id"), base))


@query(with_(POINTS) + """SELECT id, node_role, source_point_index, point_index FROM (
  SELECT id, 'primary' AS node_role, point_index AS source_point_index, point_index FROM points WHERE is_in_base
  UNION ALL SELECT id, 'overlay', point_index, (SELECT count(*) FROM points WHERE is_in_base) + row_number() OVER (ORDER BY point_index, id) - 1 FROM points WHERE NOT is_in_base AND year >= 1993)""")
def win_02(spark: SparkSession, sf: str) -> DataFrame:
    """Base and overlay with indices that go on."""
    return _overlaid(points(spark, sf)).select("id", "node_role", "source_point_index", "point_index")


@query(with_(POINTS, SCOPED) + "SELECT point_index, id, (SELECT count(*) FROM scoped) AS total_rows FROM scoped ORDER BY point_index LIMIT 10 OFFSET 10")
def tbl_01(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of ten."""
    return analytics.page(_scoped(points(spark, sf)), 2, 10).select("point_index", "id", "total_rows")


@query(with_(POINTS) + "SELECT point_index, id, title FROM points WHERE id = 'C17'")
def tbl_02(spark: SparkSession, sf: str) -> DataFrame:
    """One point by its id."""
    return analytics.point(points(spark, sf), id="C17").select("point_index", "id", "title")


@query(with_(POINTS) + ", refs AS (SELECT 'P' || (o_orderkey % 3000) AS ref FROM orders GROUP BY 1 UNION SELECT 'C3') SELECT ref, id, point_index FROM refs JOIN points ON ref = paper_id OR ref = id")
def tbl_03(spark: SparkSession, sf: str) -> DataFrame:
    """Points by paper references."""
    refs = table(spark, sf, "orders").select(F.concat(F.lit("P"), (F.col("o_orderkey") % 3000).cast("string")).alias("ref")).unionByName(spark.createDataFrame([("C3",)], "ref string"))
    return analytics.nodes_of(points(spark, sf), refs)


@query(with_(POINTS, EXEMPLARS) + "SELECT cluster_id, rank, node_id FROM exemplars WHERE cluster_id = 4 ORDER BY rank LIMIT 5")
def tbl_06(spark: SparkSession, sf: str) -> DataFrame:
    """A cluster's first exemplars."""
    return analytics.cluster_exemplars(_exemplars(points(spark, sf)), 4).select("cluster_id", "rank", "node_id")


@query(with_(POINTS) + """SELECT point_index, coalesce(display_label, title, citekey, id) AS label, title AS matched_value,
  concat_ws(' · ', nullif(citekey, ''), nullif(title, ''), nullif(cluster_label, ''), nullif(journal, ''), year::VARCHAR) AS subtitle
FROM points WHERE lower(title) LIKE '%00012%' ORDER BY CASE WHEN lower(title) = '00012' THEN 0 WHEN lower(title) LIKE '00012%' THEN 1 ELSE 2 END, length(title), point_index LIMIT 12""")
def tbl_08(spark: SparkSession, sf: str) -> DataFrame:
    """A search in titles."""
    return analytics.search(points(spark, sf), "title", " 00012").select("point_index", "label", "matched_value", "subtitle")


@query(with_(POINTS) + """, focus AS (SELECT * FROM points WHERE is_in_base AND x > 9000 AND cluster_id > 0), c AS (SELECT cluster_id, count(*) AS seed_count, max(coalesce(paper_reference_count, 0)) AS m FROM focus GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 6),
r AS (SELECT u.id, u.cluster_id, seed_count, row_number() OVER (PARTITION BY u.cluster_id ORDER BY coalesce(paper_reference_count, 0) DESC, coalesce(year, 0) DESC, point_index, u.id) AS cluster_rank FROM points u JOIN c USING (cluster_id) WHERE NOT u.is_in_base QUALIFY cluster_rank <= 4)
SELECT *, row_number() OVER (ORDER BY seed_count DESC, cluster_id, cluster_rank, id) AS global_rank FROM r QUALIFY global_rank <= 20""")  # fmt: skip
def sel_12(spark: SparkSession, sf: str) -> DataFrame:
    """Points in the clusters of a focus."""
    p = points(spark, sf)
    base = p.filter("is_in_base")
    return overlay.neighbourhood(base.filter("x > 9000"), p, base, 20, 6, 4)


@query(with_(POINTS) + "SELECT DISTINCT id FROM points WHERE NOT is_in_base AND (year = 1993 OR journal = 'BUILDING')")
def sel_13(spark: SparkSession, sf: str) -> DataFrame:
    """What several producers show."""
    p = points(spark, sf)
    base = p.filter("is_in_base")
    shown = overlay.Overlay().replace("a", p.filter("year = 1993"), p, base).replace("b", p.filter("journal = 'BUILDING'"), p, base).replace("c", p.filter("year = 1995"), p, base).clear("c")
    return shown.ids()


@query(with_(POINTS, SCOPED) + "SELECT point_index FROM scoped")
def sel_14(spark: SparkSession, sf: str) -> DataFrame:
    """A selection taken from a scope."""
    p = points(spark, sf)
    return scope.chosen(p, _scoped(p).select("point_index")).select("point_index")


@query(with_(POINTS) + """SELECT DISTINCT id FROM points WHERE (year IN (1993, 1994) AND year <> 1993 OR journal = 'BUILDING') AND NOT (journal = 'MACHINERY')""")
def set_07(spark: SparkSession, sf: str) -> DataFrame:
    """One producer's share after a change."""
    p = points(spark, sf)
    ids = lambda where: p.filter(where).select("id")
    return overlay.reconciled(ids("year in (1993, 1994)"), ids("year = 1993"), ids("journal = 'BUILDING'"), ids("journal = 'MACHINERY'"))


@query(with_(POINTS) + "SELECT id, journal FROM points UNION ALL SELECT id, 'attached' FROM points WHERE x > 9900")
def set_02(spark: SparkSession, sf: str) -> DataFrame:
    """Universe and attached rows together, repeated ones as well."""
    p = points(spark, sf)
    return p.select("id", "journal").unionByName(p.filter("x > 9900").select("id", F.lit("attached").alias("journal")))


@query(with_(POINTS) + "SELECT cluster_id, CASE WHEN coalesce(cluster_id, 0) <= 0 THEN 'grey' ELSE ['red', 'green', 'blue'][cluster_id % 3 + 1] END AS colour FROM points GROUP BY cluster_id")
def scl_24(spark: SparkSession, sf: str) -> DataFrame:
    """Colours of clusters."""
    return points(spark, sf).select("cluster_id").distinct().withColumn("colour", palette_colour(F.col("cluster_id"), ["red", "green", "blue"], "grey"))


@query(with_(POINTS, LINKS) + ", ends AS (SELECT source_node_id AS id FROM links UNION ALL SELECT target_node_id FROM links) SELECT p.id, count(e.id) AS degree FROM points p LEFT JOIN ends e ON e.id = p.id GROUP BY p.id")
def scl_26(spark: SparkSession, sf: str) -> DataFrame:
    """Ends of links of each node."""
    return views.degrees(points(spark, sf), links(spark, sf))


@query(with_(POINTS) + """SELECT '"' || id || '","' || coalesce(title, '') || '","' || coalesce(paper_id, '') || '"' AS line FROM points""")
def snk_01(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a table in which every value is quoted."""
    return files.quoted_csv(points(spark, sf), ["id", "title", "paper_id"], "point_index")


@query(with_(POINTS) + """SELECT id, round(domain_score, 6) AS domain_score FROM (SELECT *, (g * g + ln(1 + coalesce(paper_reference_count, 0)) + coalesce(greatest(0.0, 1 - (2000 - year) / 50), 0)) * CASE WHEN lower(journal) = 'building' THEN 1.5 ELSE 1 END AS domain_score
FROM (SELECT *, len(list_filter(string_split(coalesce(semantic_groups, ''), ','), lambda x: trim(x) <> '')) AS g FROM points)) ORDER BY round(domain_score, 9) DESC, point_index LIMIT 50""")
def sel_15(spark: SparkSession, sf: str) -> DataFrame:
    """The points of highest domain score."""
    return analytics_top(spark, sf)


def analytics_top(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.operators.selection import domain_score

    return domain_score(points(spark, sf), 2000, ["building"]).orderBy(F.round("domain_score", 9).desc(), "point_index").limit(50).select("id", F.round("domain_score", 6).alias("domain_score"))
