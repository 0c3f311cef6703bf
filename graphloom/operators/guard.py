"""Read-only SQL: what a user may run, and its result."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession

#: Statements that may be run, those whose rows are limited, and the limit.
ALLOWED, LIMITED, LIMIT = ("describe", "explain", "select", "show", "values", "with"), ("select", "values", "with"), 200
#: Nodes of a parsed statement that change something.
WRITES = r"InsertIntoStatement|\w*Command|Create\w+|Drop\w+|DeleteFromTable|UpdateTable|MergeIntoTable|Replace\w+"


def checked(sql: str) -> tuple[str, bool]:
    """The statement without its last semicolon, and whether its rows are limited; raises otherwise.

    One statement only: a semicolon anywhere else is refused, in a literal as well.
    """
    statement = sql.strip()
    statement = statement[:-1].rstrip() if statement.endswith(";") else statement
    if not statement:
        raise ValueError("no statement")
    if ";" in statement:
        raise ValueError("one statement only")
    word = re.match(r"\(*\s*([A-Za-z]+)", statement)
    kind = word[1].lower() if word else ""
    if kind not in ALLOWED:
        raise ValueError(f"not a read-only statement: {kind or statement[:20]}")
    return statement, kind in LIMITED


def run(spark: SparkSession, sql: str, limit: int = LIMIT) -> DataFrame:
    """The rows of a read-only statement, at most ``limit`` of a query.

    A query that would write (``WITH ... INSERT``) is refused by what Spark's parser makes of it.
    """
    statement, limited = checked(sql)
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    nodes = {m[1] for line in plan.treeString().splitlines() if (m := re.match(r"[\s:+-]*'?(\w+)", line))}
    if limited and any(re.fullmatch(WRITES, n) for n in nodes):
        raise ValueError("the statement writes")
    rows = spark.sql(statement)
    return rows.limit(limit) if limited else rows


def answer(spark: SparkSession, sql: str, limit: int = LIMIT) -> dict:
    """Columns, rows, how many, how long, and the limit that held, if any."""
    began = time.time()
    rows = run(spark, sql, limit)
    found = rows.collect()
    return {"columns": rows.columns, "rows": [r.asDict() for r in found], "row_count": len(found), "duration_ms": 1000 * (time.time() - began), "applied_limit": limit if checked(sql)[1] else None}
