"""The registered queries on the given tables, with the SQL that checks them."""

from __future__ import annotations

from graphloom.plans import graph, releases, vectors, warehouse
from graphloom.plans.base import REGISTERED, Query

__all__ = ["graph", "oracle_sql", "queries", "releases", "vectors", "warehouse"]


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}
