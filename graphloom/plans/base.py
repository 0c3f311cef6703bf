"""How queries are registered: a function of (spark, sf_dir) and, where SQL can say it, its oracle."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, tuple[Query, str | None]] = {}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long and fractions as double, so that engines agree on types."""
    kinds = {"int": "long", "smallint": "long", "tinyint": "long", "float": "double"}
    return df.select(*(F.col(f"`{c}`").cast(kinds[t]).alias(c) if t in kinds else F.col(f"`{c}`") for c, t in df.dtypes))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(f(spark, sf_dir))

        REGISTERED[f.__name__] = (run, sql)
        return run

    return register
