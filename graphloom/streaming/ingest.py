"""Incremental loading: files as they come, merged into a keyed table, each batch once.

The file source with a checkpoint resumes where it stopped; ``maxFilesPerTrigger`` bounds a batch.
A batch writes a version of its own, so one that is run again after a loss gives the same table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from graphloom.sources.ledger import Log
from graphloom.sources.merge import first_of


def files(spark: SparkSession, folder: str, schema: StructType | str, pattern: str = "*.parquet", kind: str = "parquet", per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).format(kind).load(folder)


def load(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs over what is there and stops; ``each`` gets every batch with its number."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appending(path: str) -> Callable[[DataFrame, int], None]:
    """A sink with one partition for each batch, which a second run of the batch replaces."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_id", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return write


def current(spark: SparkSession, path: str, keys: Sequence[str], schema: StructType | str | None = None) -> DataFrame:
    """The last row of each key over all batches of ``appending``."""
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return first_of(rows, keys, [F.desc("batch_id")]).drop("batch_id")


def tumbling(stream: DataFrame, time: str, width: str, late: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts by window and ``by``; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("count"))


def sessions(stream: DataFrame, time: str, gap: str, late: str, by: Sequence[str]) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("count"))


class KeyedTable:
    """A table of the last row of each key, grown by batches; a batch costs what it holds.

    A batch is written as a delta. Once deltas hold ``share`` of the base's rows they are folded into a new base, so a row
    is rewritten a few times however many batches come, and a read folds one base and few deltas. The states are
    numbered (``sources.ledger``): a batch that is run again, or one that another writer made, changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], schema: StructType, share: float = 0.5) -> None:
        self.spark, self.path, self.keys, self.order, self.schema, self.share = spark, path.rstrip("/"), list(keys), list(order), schema, share
        self.log = Log(spark, f"{self.path}/states")

    def _folded(self, parts: Sequence[str]) -> DataFrame:
        """The row of greatest ``order`` of each key, of equal ones that of the later part."""
        rows = None
        for number, part in enumerate(parts):
            read = self.spark.read.schema(self.schema).parquet(f"{self.path}/{part}").withColumn("_part", F.lit(number))
            rows = read if rows is None else rows.unionByName(read)
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        return first_of(rows, self.keys, [*(F.desc_nulls_last(c) for c in self.order), F.desc("_part")]).drop("_part")

    def merge(self, batch: DataFrame, number: int) -> None:
        """Adds batch ``number``; to be given to ``load``."""
        at, state = self.log.latest()
        state = state or {"base": None, "base_rows": 0, "deltas": [], "delta_rows": 0, "batch": -1}
        if number <= state["batch"]:
            return
        name, seen = f"delta-{number}-{uuid.uuid4().hex[:8]}", Observation()
        first_of(batch.select(*self.schema.names), self.keys, [F.desc_nulls_last(c) for c in self.order]).observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.path}/{name}")
        state = state | {"deltas": [*state["deltas"], name], "delta_rows": state["delta_rows"] + seen.get["rows"], "batch": number}
        if state["delta_rows"] > self.share * state["base_rows"]:
            base, counted = f"base-{number}-{uuid.uuid4().hex[:8]}", Observation()
            self._folded([*filter(None, [state["base"]]), *state["deltas"]]).observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.path}/{base}")
            state |= {"base": base, "base_rows": counted.get["rows"], "deltas": [], "delta_rows": 0}
        self.log.append(at, state)

    def current(self) -> DataFrame:
        """The last row of each key."""
        _, state = self.log.latest()
        return self._folded([*filter(None, [state["base"]]), *state["deltas"]] if state else [])
