"""A training-corpus pipeline: five stages from raw documents to packed sequences.

Every stage takes the rows that the one before kept, written as Parquet and read again. Stages
but the last return the columns of ``documents``; the last returns pieces of sequences.

Null and empty texts have no words and go with the first stage. Rows with equal or null ids are told apart by
their texts; of equal rows one stays. Columns may have any further names and are carried along. A very
long text is held by one task in each stage. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import discard, few_files, stored, table
from graphloom.llm.mixing import mix
from graphloom.llm.near_dedup import without_near_duplicates
from graphloom.llm.packing import pack
from graphloom.llm.quality_rules import keep, learn
from graphloom.llm.suffix_dedup import removal


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rule and the learned list keep."""
    return few_files(keep(docs, learn(docs, table(spark, sf_dir, "labels"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one of smallest doc_id. Rows of one doc_id but unlike texts all stay."""
    return few_files(without_near_duplicates(docs))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur anywhere else; a text that was nothing else goes."""
    left = removal(docs).filter("n_removed = 0 or length(kept_text) > 0").select("row", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text")).alias("left"))
    new = {"text": F.col("left"), "n_chars": F.length("left").cast("long")}
    return few_files(left.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order in which sources are mixed by the root of their size."""
    mixed = mix(docs)
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*docs.columns)


def in_written_order(docs: DataFrame) -> DataFrame:
    """The rows of a written table, partitioned and sorted as they were written: by number of file, then by row."""
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    numbered = docs.select(F.struct(*docs.columns).alias("row"), number.alias("file"), F.col("_metadata.row_index").alias("at"))
    return numbered.repartitionByRange("file", "at").sortWithinPartitions("file", "at").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids, with the ids, in the order of mixing: sequence_id rises with it from group to group.

    ``docs`` has to be a table read from the files that the stage before wrote: their order is that of mixing.
    """
    # Executors still hold workers of earlier stages here, and hand tasks to all of them in turn, so few words are remembered.
    return pack(in_written_order(docs), public_tokenizers.path("word_bpe_49k.json"), 2048, 1, cache_words=20_000)


STAGES = [("quality rules", quality), ("near duplicates", near_dedup), ("repeated passages", repeats), ("mixing", mixing), ("packing", packing)]

#: SQL has no form of learned rules, sampling or packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again; the table of a stage goes once the next is written."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
