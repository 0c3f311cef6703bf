"""The relations that operators work on, as views of the given tables, in Spark and in SQL.

Points are customers with what their orders add up to; papers are parts, annotations are events,
relations and citations are line items. The SQL states the same relations for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.files import table


def _listed(column: str) -> F.Column:
    return F.array_join(F.array_sort(F.collect_set(column)), ", ")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each customer; those of nation 0 are noise, those without orders have no paper."""
    orders = table(spark, sf_dir, "orders")
    sums = orders.groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("y"), F.year(F.min("o_orderdate")).alias("year"), F.count("*").alias("paper_reference_count"),
        _listed("o_orderpriority").alias("semantic_groups"), _listed("o_orderstatus").alias("relation_categories"),
    )
    rows = table(spark, sf_dir, "customer").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = rows.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    none = F.lit(None)
    return rows.select(
        F.col("c_custkey").alias("point_index"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("o_custkey").isNotNull(), F.concat(F.lit("P"), F.col("c_custkey").cast("string"))).alias("paper_id"),
        F.col("c_acctbal").alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"), F.col("c_nationkey").cast("long").alias("cluster_id"), F.when(F.col("c_nationkey") != 7, F.col("n_name")).alias("cluster_label"),
        F.col("c_name").alias("title"), F.lower("c_name").alias("citekey"), F.col("c_mktsegment").alias("journal"), F.col("year").cast("long").alias("year"), F.when(F.col("c_acctbal") > 5000, F.upper("c_name")).alias("display_label"),
        "semantic_groups", "relation_categories", F.when(F.col("paper_reference_count") > 10, "fulltext").otherwise("abstract").alias("text_availability"), (F.col("c_acctbal") >= 0).alias("is_in_base"), F.col("c_nationkey").cast("long").alias("base_rank"),
        none.cast("long").alias("paper_author_count"), "paper_reference_count", none.cast("long").alias("paper_entity_count"), none.cast("long").alias("paper_relation_count"), F.lit("primary").alias("node_role"),
    )


POINTS = """
  points AS (
    SELECT c_custkey AS point_index, 'C' || c_custkey AS id, CASE WHEN o.o_custkey IS NOT NULL THEN 'P' || c_custkey END AS paper_id,
      c_acctbal AS x, coalesce(o.y, 0.0) AS y, c_nationkey::BIGINT AS cluster_id, CASE WHEN c_nationkey <> 7 THEN n_name END AS cluster_label,
      c_name AS title, lower(c_name) AS citekey, c_mktsegment AS journal, o.year::BIGINT AS year, CASE WHEN c_acctbal > 5000 THEN upper(c_name) END AS display_label,
      o.semantic_groups, o.relation_categories, CASE WHEN o.paper_reference_count > 10 THEN 'fulltext' ELSE 'abstract' END AS text_availability,
      c_acctbal >= 0 AS is_in_base, c_nationkey::BIGINT AS base_rank, NULL::BIGINT AS paper_author_count, o.paper_reference_count,
      NULL::BIGINT AS paper_entity_count, NULL::BIGINT AS paper_relation_count, 'primary' AS node_role
    FROM customer
    LEFT JOIN (
      SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS y, year(min(o_orderdate)) AS year, count(*) AS paper_reference_count,
        array_to_string(list_sort(list_distinct(list(o_orderpriority))), ', ') AS semantic_groups,
        array_to_string(list_sort(list_distinct(list(o_orderstatus))), ', ') AS relation_categories
      FROM orders GROUP BY o_custkey) o ON c_custkey = o.o_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers linked to the customer whose key is their orders' number modulo many; some dangle."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("source_node_id"), F.concat(F.lit("C"), (F.col("o_orderkey") % 20_000).cast("string")).alias("target_node_id"),
        F.when(F.col("o_orderstatus") == "F", "citation").otherwise("similarity").alias("link_kind"), F.col("o_totalprice").alias("weight"), F.col("o_orderkey").alias("link_id"),
    )


LINKS = """
  links AS (
    SELECT 'C' || o_custkey AS source_node_id, 'C' || (o_orderkey % 20000) AS target_node_id,
      CASE WHEN o_orderstatus = 'F' THEN 'citation' ELSE 'similarity' END AS link_kind, o_totalprice AS weight, o_orderkey AS link_id
    FROM orders)"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as raw papers: brand and type make the venue, the key is the PubMed number."""
    venue = F.concat(F.when(F.col("p_size") > 40, "The ").otherwise(""), "p_brand", F.when(F.col("p_size") < 5, ": ").otherwise(" "), "p_type", F.when(F.col("p_size") == 7, ".").otherwise(""))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("paper_id"), F.col("p_partkey").alias("corpus_id"), F.when(F.col("p_size") != 11, F.col("p_partkey")).alias("pmid"), venue.alias("venue_raw"),
        F.when(F.col("p_size") != 13, (F.lit(1930) + F.col("p_size") * 2)).cast("int").alias("year"), F.when(F.col("p_retailprice") > 1500, F.concat(F.lit("PMC"), F.col("p_partkey").cast("string"))).alias("pmc_id"),
        F.lit(None).cast("string").alias("doi_norm"), (F.col("p_size") > 25).alias("is_open_access"), F.when(F.col("p_size") != 17, F.col("p_name")).alias("abstract"), F.col("p_name").alias("title"),
    )


PAPERS = r"""
  papers AS (
    SELECT p_partkey::VARCHAR AS paper_id, p_partkey AS corpus_id, CASE WHEN p_size <> 11 THEN p_partkey END AS pmid,
      concat(CASE WHEN p_size > 40 THEN 'The ' ELSE '' END, p_brand, CASE WHEN p_size < 5 THEN ': ' ELSE ' ' END, p_type, CASE WHEN p_size = 7 THEN '.' ELSE '' END) AS venue_raw,
      CASE WHEN p_size <> 13 THEN 1930 + p_size * 2 END::INTEGER AS year, CASE WHEN p_retailprice > 1500 THEN 'PMC' || p_partkey END AS pmc_id,
      NULL::VARCHAR AS doi_norm, p_size > 25 AS is_open_access, CASE WHEN p_size <> 17 THEN p_name END AS abstract, p_name AS title
    FROM part),
  venues AS (
    SELECT *, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(venue_raw)), '\.$', ''), '^the\s+', ''), '\s*:\s*.*$', ''), '\s*\([^)]*\)\s*$', '')), ''), '') AS normalized_venue
    FROM papers)"""


def journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory: brands, which subtitles leave behind."""
    return table(spark, sf_dir, "part").select(F.lower("p_brand").alias("normalized_venue")).distinct()


JOURNALS = "journals AS (SELECT DISTINCT lower(p_brand) AS normalized_venue FROM part)"


def venue_patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATTERN_ROWS, "pattern_key string, like_pattern string, promotes_to_mapped boolean")


PATTERN_ROWS = [("standard", "%standard%", True), ("promo", "%promo%", True), ("brand_1", "brand#1%", False)]
PATTERNS = "patterns AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{p}', {str(m).lower()})" for k, p, m in PATTERN_ROWS) + ") AS t(pattern_key, like_pattern, promotes_to_mapped))"


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as mentions: the user is the paper, the kind is what is mentioned."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pmid"), F.when(F.col("value") > 50, 2).otherwise(1).alias("entity_type"), F.concat(F.lit(" "), F.upper(kind), F.lit("  ")).alias("mention_text"),
        F.when(kind == "click", "MESH:D003693").when(kind == "view", "627").otherwise(F.concat(F.lit("X:"), kind)).alias("concept_id_raw"), F.col("event_id"),
    )


ANNOTATIONS = """
  annotations AS (
    SELECT user_id AS pmid, CASE WHEN value > 50 THEN 2 ELSE 1 END AS entity_type, ' ' || upper(event_type) || '  ' AS mention_text,
      CASE event_type WHEN 'click' THEN 'MESH:D003693' WHEN 'view' THEN '627' ELSE 'X:' || event_type END AS concept_id_raw, event_id
    FROM events)"""


def vocabulary(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Terms, and aliases with their normal form."""
    terms = spark.createDataFrame(TERM_ROWS, "term_id string, canonical_name string, category string")
    aliases = spark.createDataFrame(ALIAS_ROWS, "term_id string, alias string, is_preferred boolean, normalized_alias string")
    return terms, aliases


TERM_ROWS = [("t1", "Buying", "act"), ("t2", "Joining", "act")]
ALIAS_ROWS = [("t1", "Purchase", True, "purchase"), ("t1", "a purchase", False, "purchase"), ("t2", "Sign up", False, "signup"), ("t2", "error", False, "error")]
_rows = lambda rows: ", ".join("(" + ", ".join(str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in r) + ")" for r in rows)
VOCABULARY = f"terms AS (SELECT * FROM (VALUES {_rows(TERM_ROWS)}) AS t(term_id, canonical_name, category)), aliases AS (SELECT * FROM (VALUES {_rows(ALIAS_ROWS)}) AS t(term_id, alias, is_preferred, normalized_alias))"


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as relations between a supplier and a line status, with two sources."""
    returned = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("pmid"), F.when(returned == "R", 4).otherwise(1).alias("relation_type"), F.lit(3).alias("subject_type"), F.lit(2).alias("object_type"),
        F.col("l_suppkey").cast("string").alias("subject_entity_id"), F.when(F.col("l_linestatus") == "F", "MESH:D015430").otherwise("MESH:D000000").alias("object_entity_id"),
        F.when(returned == "N", 1).otherwise(2).alias("relation_source"), F.col("l_orderkey"), F.col("l_linenumber"),
    )


RELATIONS = """
  relations AS (
    SELECT l_partkey AS pmid, CASE WHEN l_returnflag = 'R' THEN 4 ELSE 1 END AS relation_type, 3 AS subject_type, 2 AS object_type, l_suppkey::VARCHAR AS subject_entity_id,
      CASE WHEN l_linestatus = 'F' THEN 'MESH:D015430' ELSE 'MESH:D000000' END AS object_entity_id, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS relation_source, l_orderkey, l_linenumber
    FROM lineitem)"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("citing_paper_id"), F.when(F.col("l_quantity") > 10, F.col("l_suppkey").cast("string")).alias("cited_paper_id"), (F.col("l_discount") > 0.05).alias("is_influential")
    )


CITATIONS = "citations AS (SELECT l_partkey::VARCHAR AS citing_paper_id, CASE WHEN l_quantity > 10 THEN l_suppkey::VARCHAR END AS cited_paper_id, l_discount > 0.05 AS is_influential FROM lineitem)"
METRICS = """
  metrics AS (
    SELECT citing_paper_id, count(*) AS reference_out_count, count(*) FILTER (WHERE is_influential) AS influential_reference_count, count(cited_paper_id) AS linked_reference_count,
      count(*) FILTER (WHERE cited_paper_id IS NULL) AS orphan_reference_count
    FROM citations GROUP BY citing_paper_id)"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts) + "\n"
