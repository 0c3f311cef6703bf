"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe_codec import encoded
from graphloom.llm.common import few_files, table
from graphloom.llm.conversations import damaged, repaired
from graphloom.llm.hard_negatives import hard_negatives
from graphloom.llm.html_main import extract
from graphloom.llm.license_scan import scan_licences
from graphloom.llm.mixing import mix
from graphloom.llm.near_dedup import near_duplicates
from graphloom.llm.packing import pack
from graphloom.llm.quality_rules import judge, learn
from graphloom.llm.suffix_dedup import without_repeats
from graphloom.llm.token_count import count_tokens
from graphloom.llm.topk import top_k
from graphloom.llm.toxicity import learn as learn_lexicon
from graphloom.llm.toxicity import score_toxicity


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence; its path is source/language/id."""
    documents = table(spark, sf_dir, "documents")
    files = documents.select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string")).alias("path"))
    return scan_licences(files)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block, slot and position when sources are mixed by the root of their size."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_block", "mix_slot", "mix_position")


def op3_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates."""
    return few_files(near_duplicates(table(spark, sf_dir, "documents")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 1, with_ids=False)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 200-byte strings that start anywhere else as well."""
    left = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return few_files(left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every 50th vector."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts and the verdict of a list learned from ``labels.quality``."""
    documents = table(spark, sf_dir, "documents")
    return judge(documents, learn(documents, table(spark, sf_dir, "labels")))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, learned from ``labels.toxic`` of rows not held out."""
    documents = table(spark, sf_dir, "documents")
    return score_toxicity(documents, learn_lexicon(documents, table(spark, sf_dir, "labels")))


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_content=False)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, and its cheapest repair."""
    conversations = table(spark, sf_dir, "conversations")
    return repaired(damaged(conversations), conversations.select("conv_id"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten hardest negatives of each of the five positives of every 100th vector."""
    relabelled = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(relabelled, F.col("id") % 100 == 0, 5, 10, 30, 90)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_license_scan, op2_mixing, op3_html_main, op4_near_dedup, op5_packing, op6_suffix_dedup, op7_topk, op8_quality_rules, op9_token_count, op10_toxicity, op11_bpe_codec, op12_conversation_repair, op13_hard_negatives]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_topk": OP7_SQL, "op13_hard_negatives": OP13_SQL}


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 5
"""

OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same)
  WHERE place <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
