"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, read by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent (local tests) a temporary folder stands in for it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/graphloom-checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Files of a table for each core, where many small partitions are written as few.
FILES_PER_CORE = 4


def few_files(df: DataFrame) -> DataFrame:
    """``df`` in at most ``FILES_PER_CORE`` partitions for each core: without a shuffle, a task takes several, one after the other.

    A task keeps its number for all of them, so what tells rows apart by the number of a Python task must be written first.
    """
    return df.coalesce(FILES_PER_CORE * max(1, df.sparkSession.sparkContext.defaultParallelism))


def stored(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, which cuts its lineage; as ``few`` files, if asked for.

    The files are replicated by the file system, so a lost executor loses nothing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (few_files(df) if few else df).write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote for frames that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def require(df: DataFrame, columns: Iterable[str]) -> None:
    """Raises if ``df`` lacks one of ``columns``; further columns are ignored by every operator."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def text_or_empty(column: str = "text") -> F.Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def give_back() -> None:
    """Returns what a Python worker has freed to the system. Workers stay for later stages, and keep what they freed
    (of Arrow's batches above all) while other workers and the JVM beside them need it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only some C libraries have it
        trim(0)
