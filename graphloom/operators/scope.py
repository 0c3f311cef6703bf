"""Scopes of an analysis: the whole dataset, what is visible, or what is selected.

Clauses carry the id of what made them. Those of filters, timelines and budgets decide what is
visible; all others are intents. A widget's own clause can be left out of its own scope.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import list_values

VISIBLE, BUDGET = ("filter:", "timeline:", "budget:"), ("filter:", "timeline:")
#: Selected keys up to which they are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


@dataclass(frozen=True)
class Clause:
    source: str
    predicate: Column


@dataclass(frozen=True)
class Selection:
    """Clauses, and the indices of a locked baseline, if any."""

    clauses: tuple[Clause, ...] = field(default=())
    baseline: DataFrame | None = None
    locked: bool = False

    def _all(self, wanted) -> Column | None:
        found = [c.predicate for c in self.clauses if wanted(c.source)]
        return functools.reduce(operator.and_, found) if found else None

    def visible(self, without: str | None = None) -> Column | None:
        return self._all(lambda s: s.startswith(VISIBLE) and s != without)

    def budget(self) -> Column | None:
        return self._all(lambda s: s.startswith(BUDGET))

    def intent(self) -> Column | None:
        return self._all(lambda s: not s.startswith(VISIBLE))

    def active(self) -> Column | None:
        return self._all(lambda _: True)


def _where(points: DataFrame, predicate: Column | None) -> DataFrame:
    return points if predicate is None else points.filter(predicate)


def chosen(points: DataFrame, indices: DataFrame, index: str = "point_index") -> DataFrame:
    """Rows whose index is in ``indices`` (a column of the same name)."""
    wanted = indices.select(index).distinct()
    small = wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return points.join(F.broadcast(wanted) if small else wanted, index, "left_semi")


def scoped(points: DataFrame, scope: str, selection: Selection | None = None, selected: DataFrame | None = None, without: str | None = None) -> DataFrame:
    """``points`` in scope ``dataset``, ``current`` or ``selected``.

    A locked selection with a baseline is current within that baseline only. ``selected`` without
    indices is empty.
    """
    if scope == "dataset":
        return points
    if scope == "selected":
        return chosen(points, selected) if selected is not None else points.limit(0)
    if scope != "current":
        raise ValueError(f"no such scope: {scope}")
    selection = selection or Selection()
    seen = _where(points, selection.visible(without))
    return chosen(seen, selection.baseline) if selection.locked and selection.baseline is not None else seen


def baseline_scope(selection: Selection) -> str:
    """What a widget compares with: the selection where it is locked, else the dataset."""
    return "selected" if selection.locked and selection.baseline is not None else "dataset"


def table_scope(has_current: bool, has_selected: bool, view: str) -> str:
    """What a table shows: the current subset before the selection before the dataset."""
    if view == "dataset" or not (has_current or has_selected):
        return "dataset"
    return "current" if has_current else "selected"


def is_value(column: str, value: str | None, multiple: bool = False) -> Column:
    """Rows with a value in a column; ``"null"`` asks for none, a multiple column for membership."""
    if value is None or value == "null":
        return F.col(column).isNull()
    if multiple:
        return F.array_contains(list_values(F.col(column)), value)
    return F.col(column).cast("string") == value


def within(column: str, low: float, high: float) -> Column:
    return F.col(column).between(low, high)


def year_from(column: str, floor: int) -> Column:
    """Rows of that year or later, and those without one."""
    return F.col(column).isNull() | (F.col(column) >= floor)


def gate(wanted: bool, predicate: Column) -> Column:
    return predicate if wanted else F.lit(True)


def focus(seed: int, cluster: int | None = None, box: tuple[float, float, float, float] | None = None, index: str = "point_index") -> Column:
    """A seed, its cluster, and what lies in a box of x_min, x_max, y_min, y_max."""
    found = F.col(index) == seed
    if cluster is not None and cluster > 0:
        found = found | (F.col("cluster_id") == cluster)
    if box is not None:
        found = found | (within("x", *box[:2]) & within("y", *box[2:]))
    return found


def retrieval_filter(years: tuple[int, int] | None = None, venues: list[str] | None = None, concepts: list[str] | None = None, ids: list | None = None) -> Column:
    """The conjunction of the given limits on year, venue, concepts (an array) and id."""
    found = [F.lit(True)]
    if years:
        found.append(F.col("year").between(*years))
    if venues:
        found.append(F.col("journal").isin(venues))
    if concepts:
        found.append(F.arrays_overlap("concepts", F.array(*map(F.lit, concepts))))
    if ids:
        found.append(F.col("id").isin(ids))
    return functools.reduce(operator.and_, found)


def availability(ids: DataFrame, *stores: tuple[str, DataFrame], key: str = "id") -> DataFrame:
    """Each id with the first store that has it; ``missing`` where none has."""
    left, found = ids.select(key).distinct(), None
    for name, rows in stores:
        here = left.join(rows.select(key), key, "left_semi").withColumn("store", F.lit(name))
        found = here if found is None else found.unionByName(here)
        left = left.join(rows.select(key), key, "left_anti")
    rest = left.withColumn("store", F.lit("missing"))
    return rest if found is None else found.unionByName(rest)
