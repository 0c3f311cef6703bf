"""Queries over vectors: an inverted file, a graph of neighbours, and the groups, outliers and labels that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import channels, clusters, retrieval
from graphloom.operators.postings import WordIndex
from graphloom.operators.vectors import VectorIndex, neighbour_graph
from graphloom.plans.base import query
from graphloom.sources.files import kept, scratch, table

COSINES = """norms AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
cosines AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM norms q JOIN norms c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)"""


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("WITH " + COSINES + " SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cosines QUALIFY rank <= 200")
def ret_02(spark: SparkSession, sf: str) -> DataFrame:
    """The 200 nearest vectors of a stated query set from an inverted file, in its exact mode."""
    vectors = table(spark, sf, "embeddings")
    index = VectorIndex.build(vectors, scratch(spark, "index"))
    return index.search(_asked(vectors), 200, exact=True).select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query("WITH " + COSINES + ", first AS (SELECT query_id FROM cosines GROUP BY 1) SELECT count(*)::BIGINT AS queries, 20 * count(*)::BIGINT AS found, true AS recall_reached FROM first")
def ret_02_probes(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a search that reads the probed cells alone finds nine of ten of the exact neighbours (20 for each query)."""
    vectors = table(spark, sf, "embeddings")
    index = VectorIndex.build(vectors, scratch(spark, "index"))
    near = kept(index.search(_asked(vectors), 20), "near")
    exact = index.search(_asked(vectors), 20, exact=True).select("query_id", "id")
    both = near.join(exact.withColumn("true", F.lit(1)), ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("found"), (F.count("true") >= 0.9 * F.count("*")).alias("recall_reached"))


def _graph(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    return neighbour_graph(table(spark, sf, "embeddings"), k)


@query("SELECT vec_id, 10::BIGINT AS neighbours, true AS recall_reached FROM embeddings WHERE vec_id % 100 = 0")
def ret_09_graph(spark: SparkSession, sf: str) -> DataFrame:
    """A graph of ten neighbours for each vector, and whether nine of ten edges of a stated set are those of brute force."""
    graph = kept(_graph(spark, sf), "graph")
    vectors = table(spark, sf, "embeddings")
    exact = retrieval.nearest(vectors, _asked(vectors), 10).select(F.col("query_id").alias("id"), F.col("vec_id").alias("other"), F.lit(1).alias("true"))
    held = graph.filter("id % 100 = 0").join(exact, ["id", "other"], "left").groupBy("id").agg(F.count("*").alias("neighbours"), F.count("true").alias("right"))
    reached = held.agg((F.sum("right") >= 0.9 * F.sum("neighbours")).alias("recall_reached"))
    return held.crossJoin(F.broadcast(reached)).select(F.col("id").alias("vec_id"), "neighbours", "recall_reached")


@query("SELECT count(*)::BIGINT AS nodes, true AS connected, true AS named_by_smallest, true AS several, true AS modular FROM embeddings")
def ret_09_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Communities of the graph of neighbours, by what has to hold for them: each is connected and named by its
    smallest node, there are several, and their modularity is above that of the labels' groups."""
    edges = kept(clusters.undirected(_graph(spark, sf)), "graph-edges")
    found = clusters.communities(edges)
    parts = clusters.connected(edges, found).groupBy("community").count()
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("community"))
    modular = clusters.modularity(edges, found) >= clusters.modularity(edges, labels)
    sizes = found.groupBy("community").agg(F.count("*").alias("n"), (F.min("id") == F.col("community")).alias("smallest"))
    told = sizes.agg(F.sum("n").alias("nodes"), F.count("*").alias("communities"), F.bool_and("smallest").alias("named_by_smallest"))
    return told.crossJoin(F.broadcast(parts.agg(F.count("*").alias("parts")))).select("nodes", (F.col("parts") == F.col("communities")).alias("connected"), "named_by_smallest", (F.col("communities") > 1).alias("several"), F.lit(modular).alias("modular"))


PLACES = """places AS (SELECT c_custkey AS id, c_acctbal::DOUBLE AS x, coalesce(y, 0.0) AS y FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / 1000 AS y FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""


def _places(spark: SparkSession, sf: str) -> DataFrame:
    sums = table(spark, sf, "orders").groupBy("o_custkey").agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 1000).alias("y"))
    rows = table(spark, sf, "customer").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


@query("WITH " + PLACES + """, pairs AS (SELECT a.id, b.id AS other, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d FROM places a JOIN places b ON a.id <> b.id),
near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, other) <= 20),
wide AS (SELECT id, max(d) AS width FROM near GROUP BY id),
dens AS (SELECT n.id, 1 / (avg(greatest(n.d, w.width)) + 1e-10) AS density FROM near n JOIN wide w ON n.other = w.id GROUP BY n.id),
lof AS (SELECT n.id, round(avg(t.density) / any_value(o.density), 6) AS lof FROM near n JOIN dens t ON n.other = t.id JOIN dens o ON n.id = o.id GROUP BY n.id)
SELECT id, lof, lof > (SELECT quantile_cont(lof, 0.98) FROM lof) AS is_outlier FROM lof""")
def ret_09_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Local outlier factors of places by their 20 nearest, from an inverted file in its exact mode."""
    rows = kept(_places(spark, sf).select("id", F.array("x", "y").alias("embedding")), "places")
    index = VectorIndex.build(rows, scratch(spark, "index"), "id", cosine=False)
    near = index.search(rows.withColumnRenamed("id", "query_id"), 20, probes=1, exact=True)
    return clusters.outliers(near.select(F.col("query_id").alias("id"), F.col("id").alias("other"), (-F.col("score")).alias("distance")))


@query("WITH " + PLACES + """, r AS (SELECT id, round(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 3) AS radius FROM places, (SELECT avg(x) AS cx, avg(y) AS cy FROM places))
SELECT id, radius, radius > (SELECT quantile_cont(radius, 0.99) FROM r) AS is_beyond FROM r""")
def ret_09_radial(spark: SparkSession, sf: str) -> DataFrame:
    """Places beyond the 99th percentile of distances from the mean."""
    return clusters.beyond(_places(spark, sf), "x", "y")


@query("""WITH t AS (SELECT source AS cluster, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents WHERE source IS NOT NULL),
c AS (SELECT cluster, term, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT cluster, sum(n) AS size FROM c GROUP BY 1), e AS (SELECT term, sum(n) AS total FROM c GROUP BY 1)
SELECT cluster, term, round(n / size * ln(1 + (SELECT avg(size) FROM s) / total), 9) AS weight, row_number() OVER (PARTITION BY cluster ORDER BY round(n / size * ln(1 + (SELECT avg(size) FROM s) / total), 9) DESC, term) AS rank
FROM c JOIN s USING (cluster) JOIN e USING (term) QUALIFY rank <= 10""")
def ret_09_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The ten words that tell each source's documents from the others'."""
    return clusters.cluster_labels(table(spark, sf, "documents"), "source")


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
WORD_SCORES = f"""w AS (SELECT doc_id, 'text' AS field, 1.0 AS weight, {_WORDS.format('text')} AS w FROM documents UNION ALL SELECT doc_id, 'source', 0.5, {_WORDS.format('source')} FROM documents),
f AS (SELECT field, count(*) AS n, avg(len(w)) AS mean FROM w GROUP BY field),
tf AS (SELECT field, doc_id, weight, len(any_value(w)) AS size, term, count(*) AS tf FROM (SELECT *, unnest(w) AS term FROM w) GROUP BY field, doc_id, weight, term),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_slice({_WORDS.format('text')}, 1, 4)) AS term FROM benchmark),
s AS (SELECT query_id, doc_id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (field, term) JOIN f USING (field) GROUP BY query_id, doc_id)"""


@query("WITH " + WORD_SCORES + " SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20")
def ret_01_index(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best documents for the first four words of each benchmark item, from an index whose blocks are skipped where they can't matter."""
    index = WordIndex.build(table(spark, sf, "documents"), scratch(spark, "words"), ["text", "source"])
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(retrieval.words(F.coalesce("text", F.lit(""))), 1, 4).alias("terms"))
    return index.search(asked, 20, {"text": 1.0, "source": 0.5}).withColumnRenamed("doc", "doc_id")


LANES = """l AS (SELECT s_nationkey AS query_id, l_partkey AS id, l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_quantity::DECIMAL(18,2) AS q, l_extendedprice::DECIMAL(18,2) AS p, l_discount::DECIMAL(18,4) AS d FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
lanes AS (
  SELECT query_id, 'lexical' AS channel, id, sum(q)::DOUBLE AS score FROM l GROUP BY query_id, id UNION ALL
  SELECT query_id, 'chunk_lexical', id, max(p)::DOUBLE FROM l GROUP BY query_id, id UNION ALL
  SELECT query_id, 'dense_query', id, max(d)::DOUBLE FROM l GROUP BY query_id, id UNION ALL
  SELECT query_id, 'entity_match', id, count(DISTINCT l_suppkey)::DOUBLE FROM l GROUP BY query_id, id UNION ALL
  SELECT query_id, 'relation_match', id, count(*)::DOUBLE FROM l WHERE l_returnflag = 'R' GROUP BY query_id, id UNION ALL
  SELECT n_nationkey, 'semantic_neighbor', p_partkey, p_size::DOUBLE FROM nation JOIN part ON p_size % 25 = n_nationkey),
ranks AS (SELECT query_id, channel, id, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, id) AS rank FROM lanes QUALIFY rank <= 100),
found AS (SELECT query_id, id, round(sum(CASE channel WHEN 'lexical' THEN 2.0 ELSE 1.0 END / (60 + rank)), 9) AS fused, array_to_string(list_sort(list(channel || ':' || rank)), ' ') AS trace FROM ranks GROUP BY query_id, id),
cites AS (SELECT a.l_partkey AS citing, b.l_partkey AS cited FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
links AS (SELECT citing AS a, cited AS b FROM cites WHERE citing <> cited UNION SELECT cited, citing FROM cites WHERE citing <> cited),
first AS (SELECT query_id, id AS a, fused FROM found QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) <= 30),
met AS (SELECT query_id, b AS id, sum(fused) AS s FROM first JOIN links USING (a) GROUP BY query_id, b),
known AS (SELECT met.* FROM met JOIN found USING (query_id, id)),
boosts AS (SELECT query_id, id, round(s / max(s) OVER (PARTITION BY query_id), 9) AS boost FROM known),
scored AS (SELECT query_id, id, round(fused + coalesce(boost, 0) * 0.5 / 61, 9) AS score, trace || CASE WHEN boost IS NULL THEN '' ELSE ' citation_context' END AS trace FROM found LEFT JOIN boosts USING (query_id, id))"""


@query("WITH " + LANES + " SELECT query_id, id, score, trace, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 40")
def ret_07(spark: SparkSession, sf: str) -> DataFrame:
    """Six channels and a boost along citations, by nation: parts are papers, and a line item's part cites that of the next line."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("query_id")), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("id", F.col("l_partkey"))
    money = lambda c, t="decimal(18,2)": F.col(c).cast(t)
    by = lines.groupBy("query_id", "id")
    neighbours = table(spark, sf, "nation").join(table(spark, sf, "part").withColumn("n", F.col("p_size") % 25), F.col("n") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("query_id"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score"))
    lanes = {
        "lexical": by.agg(F.sum(money("l_quantity")).cast("double").alias("score")),
        "chunk_lexical": by.agg(F.max(money("l_extendedprice")).cast("double").alias("score")),
        "dense_query": by.agg(F.max(money("l_discount", "decimal(18,4)")).cast("double").alias("score")),
        "entity_match": by.agg(F.count_distinct("l_suppkey").cast("double").alias("score")),
        "relation_match": lines.filter("l_returnflag = 'R'").groupBy("query_id", "id").agg(F.count("*").cast("double").alias("score")),
        "semantic_neighbor": neighbours,
    }
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    following = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("cited"))
    cites = line.withColumnRenamed("l_partkey", "citing").join(following, ["l_orderkey", "l_linenumber"]).select("citing", "cited")
    return channels.search(lanes, cites, 40, {"lexical": 2.0})
