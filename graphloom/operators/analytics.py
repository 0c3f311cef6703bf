"""Summaries, value counts, facets, histograms, search and paging over scoped points.

Several columns are counted in one scan: their values are unpivoted and grouped by column and
value, so a batch costs one shuffle of partial counts and not one scan for each column.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import list_values

MOST_BINS, MOST_FOUND = 64, 25
#: Columns of counts, whose few large values would squeeze all others into one bin.
BY_QUANTILES = frozenset({"paper_author_count", "paper_reference_count", "paper_entity_count", "paper_relation_count"})


def summary(scope: DataFrame, total: int) -> DataFrame:
    """One row: counts by role, papers, clusters, noise and years; whether the scope is a part."""
    cluster = F.coalesce("cluster_id", F.lit(0))
    role = F.coalesce("node_role", F.lit("primary"))
    row = scope.agg(
        F.count("*").alias("scoped_count"),
        F.count_if(role != "overlay").alias("base_count"),
        F.count_if(role == "overlay").alias("overlay_count"),
        F.count_distinct(F.nullif("paper_id", F.lit(""))).alias("paper_count"),
        F.count_distinct(F.when(cluster > 0, cluster)).alias("cluster_count"),
        F.count_if(cluster <= 0).alias("noise_count"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
    )
    return row.select(F.lit(total).cast("long").alias("total_count"), "*", (F.col("scoped_count") < total).alias("is_subset"))


def top_clusters(scope: DataFrame, limit: int = 8) -> DataFrame:
    """The largest clusters, ties to the smaller id; ``limit`` is held to 1..100."""
    real = scope.filter(F.coalesce("cluster_id", F.lit(0)) > 0)
    counted = real.groupBy("cluster_id").agg(F.max("cluster_label").alias("cluster_label"), F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), "cluster_id").limit(max(1, min(limit, 100)))


def unpivoted(scope: DataFrame, columns: Iterable[str], multiple: Iterable[str] = ()) -> DataFrame:
    """column_key, value of every column: text, without nulls and empty ones; multiple values cut."""
    columns, multiple = [*columns], set(multiple)
    if not columns:
        return scope.sparkSession.createDataFrame([], "column_key string, value string")

    def values(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.coalesce(list_values(text), F.array().cast("array<string>")) if c in multiple else F.array(text)

    def keyed(c: str) -> Column:
        return F.transform(values(c), lambda v: F.struct(F.lit(c).alias("column_key"), v.alias("value")))

    pairs = F.flatten(F.array(*map(keyed, columns)))
    return scope.select(F.explode(pairs).alias("pair")).select("pair.*").filter("value <> ''")


def value_counts(scope: DataFrame, columns: Iterable[str], limit: int, multiple: Iterable[str] = ()) -> DataFrame:
    """column_key, value, count, row_rank of the most frequent values of each column."""
    counted = unpivoted(scope, columns, multiple).groupBy("column_key", "value").agg(F.count("*").alias("count"))
    ranked = Window.partitionBy("column_key").orderBy(F.desc("count"), "value")
    return counted.withColumn("row_rank", F.row_number().over(ranked)).filter(F.col("row_rank") <= max(1, limit))


def all_value_counts(scope: DataFrame, columns: Iterable[str], multiple: Iterable[str] = ()) -> DataFrame:
    """column_key, value, count of every value of each column."""
    return unpivoted(scope, columns, multiple).groupBy("column_key", "value").agg(F.count("*").alias("count"))


def facets(dataset: DataFrame, scope: DataFrame, columns: Iterable[str], limit: int, multiple: Iterable[str] = (), deep: int = 4, exact: bool = False) -> DataFrame:
    """column_key, value, scoped_count, total_count, row_rank: the scope's values first, then others.

    Each side is cut at ``deep`` times the limit, so a scoped value outside the dataset's first
    values has a total of 0; ``exact`` leaves the dataset's side whole.
    """
    columns = [*columns]
    limit = max(1, limit)
    here = value_counts(scope, columns, limit * deep, multiple).select("column_key", "value", F.col("count").alias("scoped_count"))
    if exact:
        there = unpivoted(dataset, columns, multiple).groupBy("column_key", "value").agg(F.count("*").alias("total_count"))
    else:
        there = value_counts(dataset, columns, limit * deep, multiple).select("column_key", "value", F.col("count").alias("total_count"))
    both = here.join(there, ["column_key", "value"], "full_outer")
    order = Window.partitionBy("column_key").orderBy(F.col("scoped_count").isNull(), F.desc("scoped_count"), F.when(F.col("scoped_count").isNull(), -F.col("total_count")), "value")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    ranked = both.withColumn("row_rank", F.row_number().over(order)).filter(F.col("row_rank") <= limit)
    return ranked.select("column_key", "value", zero("scoped_count"), zero("total_count"), "row_rank")


def session_facets(dataset: DataFrame, scope: DataFrame, columns: Iterable[str], limit: int = 6, multiple: Iterable[str] = ()) -> DataFrame:
    """Facets merged at a depth of at least 24 values."""
    limit = max(1, limit)
    deep = -(-max(limit, 24) // limit)
    return facets(dataset, scope, columns, limit, multiple, deep)


def numeric_values(scope: DataFrame, columns: Iterable[str]) -> DataFrame:
    """column_key, value of every numeric column, without nulls."""
    columns = [*columns]
    if not columns:
        return scope.sparkSession.createDataFrame([], "column_key string, value double")
    pairs = F.array(*(F.struct(F.lit(c).alias("column_key"), F.col(c).cast("double").alias("value")) for c in columns))
    return scope.select(F.explode(pairs).alias("pair")).select("pair.*").filter("value is not null")


#: The share on either side of a quantile within which its exact place is looked for, and values up to which it is looked
#: for among all. Approximate quantiles are off by a tenth of that share at most.
BETWEEN, FEW_VALUES = 0.001, 10_000


def column_quantiles(values: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """column_key and ``quantiles``, exact and interpolated as ``percentile``, of (column_key, value).

    No task meets all values of a column: approximate quantiles bound where each rank lies, ranks below a
    bound are counted, and only distinct values between the bounds are ranked, a five-hundredth of them; all are if
    there are few.
    """
    near = [min(max(q + d, 0.0), 1.0) for q in shares for d in (-BETWEEN, BETWEEN)]
    ends = values.groupBy("column_key").agg(F.percentile_approx("value", F.array(*map(F.lit, near)), 10_000).alias("ends"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"))
    # One row for each column.
    bounded = values.join(F.broadcast(ends), "column_key")
    found = None
    for i, q in enumerate(shares):
        few = F.col("n") < FEW_VALUES
        low = F.when(few | (F.lit(q) <= BETWEEN), F.col("least")).otherwise(F.col("ends")[2 * i])
        high = F.when(few | (F.lit(q) >= 1 - BETWEEN), F.col("most")).otherwise(F.col("ends")[2 * i + 1])
        inside = bounded.filter((F.col("value") >= low) & (F.col("value") <= high)).groupBy("column_key", "value", "n").agg(F.count("*").alias("times"))
        below = bounded.groupBy("column_key").agg(F.count_if(F.col("value") < low).alias("below"))
        upto = F.sum("times").over(Window.partitionBy("column_key").orderBy("value"))
        ranked = inside.join(F.broadcast(below), "column_key").withColumn("last", F.col("below") + upto - 1)
        place = (F.col("n") - 1) * F.lit(float(q))
        # The value at a rank is the least one whose last rank is no lower.
        at = lambda rank: F.min(F.when(F.col("last") >= rank, F.col("value")))
        own = ranked.groupBy("column_key", "n").agg(at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b")).select("column_key", F.lit(i).alias("i"), (F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place))).alias("x"))
        found = own if found is None else found.unionByName(own)
    return found.groupBy("column_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("quantiles"))


def column_bounds(scope: DataFrame, columns: Iterable[str], quantiles: bool) -> DataFrame:
    """column_key, low, high: the outer quantiles of each column, or its ends."""
    values = numeric_values(scope, columns)
    if quantiles:
        return column_quantiles(values, (0.05, 0.95)).select("column_key", F.col("quantiles")[0].alias("low"), F.col("quantiles")[1].alias("high"))
    return values.groupBy("column_key").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def histogram(scope: DataFrame, columns: Iterable[str], bins: int = 16, extent: tuple[float, float] | None = None, extents: dict[str, tuple[float, float]] | None = None, quantiles: bool = False) -> DataFrame:
    """column_key, bin, bin_min, bin_max, count, total_count of the bins that have rows.

    Bounds are the column's own extent, else the common one, else the 5 % and 95 % quantiles,
    else the least and the greatest value. Values outside go to the first or last bin. If both
    bounds are equal there is one bin.
    """
    bins = max(1, min(bins, MOST_BINS))
    values = numeric_values(scope, columns)
    low, high = F.min("value"), F.max("value")
    if extent:
        low, high = F.lit(float(extent[0])), F.lit(float(extent[1]))
    stats = values.groupBy("column_key").agg(low.alias("low"), high.alias("high"), F.count("*").alias("total_count"))
    if quantiles and not extent:
        ends = column_quantiles(values, (0.05, 0.95))
        stats = stats.join(ends, "column_key").select("column_key", F.col("quantiles")[0].alias("low"), F.col("quantiles")[1].alias("high"), "total_count")
    for c, (a, b) in (extents or {}).items():
        own = F.col("column_key") == c
        stats = stats.withColumns({"low": F.when(own, float(a)).otherwise(F.col("low")), "high": F.when(own, float(b)).otherwise(F.col("high"))})
    # One row for each column.
    placed = values.join(F.broadcast(stats), "column_key")
    width = (F.col("high") - F.col("low")) / bins
    inside = F.least(F.greatest("value", "low"), F.col("high"))
    at = F.least(F.greatest(F.floor(F.try_divide(inside - F.col("low"), width)), F.lit(0)), F.lit(bins - 1))
    number = F.when(F.col("low") == F.col("high"), 0).otherwise(at).cast("int")
    counted = placed.groupBy("column_key", "low", "high", "total_count", number.alias("bin")).agg(F.count("*").alias("count"))
    one = F.col("low") == F.col("high")
    return counted.select(
        "column_key", "bin", F.when(one, F.col("low")).otherwise(F.col("low") + width * F.col("bin")).alias("bin_min"),
        F.when(one, F.col("high")).otherwise(F.col("low") + width * (F.col("bin") + 1)).alias("bin_max"), "count", "total_count",
    )


def mean_of_decimals(value: Column) -> Column:
    """The mean of doubles, whatever the order of their sum, if all of them are decimals of twelve places at most; else as ``avg``."""
    exact = value.try_cast("decimal(38,12)")
    total = F.when(F.bool_and(F.coalesce(exact.cast("double") == value, F.lit(False))), F.try_sum(exact).cast("double"))
    return F.coalesce(total / F.count(value), F.avg(value))


def numeric_stats(scope: DataFrame, columns: Iterable[str]) -> DataFrame:
    """column_key, least, median (exact), mean and greatest; a column without values is left out."""
    values = numeric_values(scope, columns)
    simple = values.groupBy("column_key").agg(F.min("value").alias("min_value"), mean_of_decimals(F.col("value")).alias("avg_value"), F.max("value").alias("max_value"))
    median = column_quantiles(values, (0.5,)).select("column_key", F.col("quantiles")[0].alias("median_value"))
    return simple.join(median, "column_key").select("column_key", "min_value", "median_value", "avg_value", "max_value")


def bounding_box(scope: DataFrame) -> DataFrame:
    """One row of x_min, y_min, x_max, y_max; nulls where empty, a sliver where flat."""
    box = scope.agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max("x").alias("x_max"), F.max("y").alias("y_max"))
    wide = lambda a, b: F.when(F.col(a) == F.col(b), F.col(b) + 1e-6).otherwise(F.col(b)).alias(b)
    return box.select("x_min", "y_min", wide("x_min", "x_max"), wide("y_min", "y_max"))


def visibility_budget(points: DataFrame, scope: DataFrame, seed: Column) -> DataFrame:
    """One row: the seed, its cluster and a box around it that the cluster and the scope size.

    A cluster of over 4000 scoped points is not included whole.
    """
    start = points.filter(seed).orderBy("point_index").limit(1).select(F.col("point_index").alias("seed_index"), F.col("x").alias("seed_x"), F.col("y").alias("seed_y"), F.when(F.coalesce("cluster_id", F.lit(0)) > 0, F.col("cluster_id")).alias("seed_cluster"))
    spread = lambda c: F.max(c) - F.min(c)
    extents = scope.agg(spread("x").alias("scope_x"), spread("y").alias("scope_y"))
    of_cluster = scope.join(F.broadcast(start), F.col("cluster_id") == F.col("seed_cluster")).agg(F.count("*").alias("n"), spread("x").alias("cluster_x"), spread("y").alias("cluster_y"))
    # All three have one row.
    row = start.join(extents, how="left", on=F.lit(True)).join(of_cluster, how="left", on=F.lit(True))
    share = F.when(F.col("n") > 4000, 0.12).otherwise(0.18)

    def pad(axis: str) -> Column:
        whole = F.col(f"scope_{axis}")
        wanted = F.coalesce(F.col(f"cluster_{axis}") * share, whole * 0.02, F.lit(0.001))
        least = F.coalesce(whole * 0.01, F.lit(0.001))
        most = F.greatest(F.coalesce(whole * 0.08, F.lit(0.02)), F.lit(0.02))
        return F.least(F.greatest(wanted, least, F.lit(0.001)), most)

    has = F.col("seed_cluster").isNotNull()
    return row.select(
        "seed_index", F.when(has & (F.col("n") > 0), F.col("seed_cluster")).alias("cluster_id"), (has & F.col("n").between(1, 4000)).alias("include_cluster"),
        (F.col("seed_x") - pad("x")).alias("x_min"), (F.col("seed_x") + pad("x")).alias("x_max"), (F.col("seed_y") - pad("y")).alias("y_min"), (F.col("seed_y") + pad("y")).alias("y_max"),
    )


def paper_refs(scope: DataFrame) -> DataFrame:
    """Distinct papers of a scope, or ids of points without one."""
    ref = F.trim(F.coalesce("paper_id", "id"))
    return scope.select(ref.alias("ref")).filter("ref <> ''").distinct()


def page(scope: DataFrame, number: int, size: int) -> DataFrame:
    """One page in order of the index, with the scope's size; numbers under 1 count as 1."""
    number, size = max(1, number), max(1, size)
    total = scope.agg(F.count("*").alias("total_rows"))
    rows = scope.orderBy("point_index").offset((number - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total))


def search(scope: DataFrame, column: str, term: str, limit: int = 12) -> DataFrame:
    """Points whose column holds the term: equal ones first, then beginnings, then the shortest.

    Terms under two characters find nothing; ``%`` and ``_`` stand for any characters.
    """
    term = term.strip().lower()
    if len(term) < 2:
        return scope.limit(0).withColumns({"label": F.lit(""), "matched_value": F.lit(""), "subtitle": F.lit("")})
    text = F.col(column).cast("string")
    found = scope.filter(F.lower(text).like(f"%{term}%"))
    rank = F.when(F.lower(text) == term, 0).when(F.lower(text).like(f"{term}%"), 1).otherwise(2)
    label = F.coalesce("display_label", "title", "citekey", "id")
    parts = F.concat_ws(" · ", *(F.nullif(c, F.lit("")) for c in ("citekey", "title", "cluster_label", "journal")), F.col("year").cast("string"))
    shaped = found.withColumns({"label": label, "matched_value": text, "subtitle": parts})
    return shaped.orderBy(rank, F.length(text), "point_index").limit(max(1, min(limit, MOST_FOUND)))


def point(points: DataFrame, id: str | None = None, index: int | None = None) -> DataFrame:
    """One point, by id before index."""
    return points.filter(F.col("id") == id if id is not None else F.col("point_index") == index).orderBy("point_index").limit(1)


def nodes_of(points: DataFrame, refs: DataFrame) -> DataFrame:
    """The point of each paper reference, found by paper or by id; the last of several."""
    named = points.withColumn("ref", F.explode(F.array_distinct(F.array("paper_id", "id")))).filter("ref is not null")
    found = named.join(refs.select("ref").distinct(), "ref", "left_semi")
    return found.groupBy("ref").agg(F.max_by(F.struct("id", "point_index"), "point_index").alias("n")).select("ref", "n.id", "n.point_index")


def cluster_exemplars(exemplars: DataFrame, cluster: int, limit: int = 5) -> DataFrame:
    return exemplars.filter(F.col("cluster_id") == cluster).orderBy("rank").limit(limit)


def sample(points: DataFrame, size: int, seed: int) -> DataFrame:
    """The same ``size`` points with a paper for each seed: those of smallest digest."""
    return points.filter("paper_id is not null").orderBy(F.md5(F.concat_ws("|", "id", F.lit(seed))), "id").limit(size)


def widget_bars(dataset: DataFrame, scope: DataFrame | None, columns: list[str], limit: int = 8, multiple: Iterable[str] = ()) -> DataFrame:
    """Value counts of the scope, or of the dataset where there is none; multiple values are cut."""
    return value_counts(dataset if scope is None else scope, columns, limit, set(multiple) & set(columns))


def panel(dataset: DataFrame, selected: DataFrame | None, current: DataFrame | None, categories: list[str], numbers: list[str], limit: int = 24, bins: int = 16, multiple: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """What all widgets of a panel show, by layer (``dataset``, ``selection``, ``filtered``): values with counts, and histograms.

    Columns of counts (``BY_QUANTILES``) get bounds at their outer quantiles, others at their ends; those of the
    dataset hold for every layer, so that layers can be laid over each other. A layer that is not given is left out.
    """
    layers = [(name, rows) for name, rows in (("dataset", dataset), ("selection", selected), ("filtered", current)) if rows is not None]
    few, wide = [c for c in numbers if c in BY_QUANTILES], [c for c in numbers if c not in BY_QUANTILES]
    # One row for each column.
    bounds = {r["column_key"]: (r["low"], r["high"]) for r in column_bounds(dataset, few, True).unionByName(column_bounds(dataset, wide, False)).collect()}
    values = shown = None
    for name, rows in layers:
        counted = value_counts(rows, categories, limit, multiple).withColumn("layer", F.lit(name))
        placed = histogram(rows, [c for c in numbers if c in bounds], bins, extents=bounds).withColumn("layer", F.lit(name))
        values = counted if values is None else values.unionByName(counted)
        shown = placed if shown is None else shown.unionByName(placed)
    return values, shown


def session_bars(dataset: DataFrame, scopes: dict[str, DataFrame], scope: str, columns: list[str], limit: int = 8, multiple: Iterable[str] = ()) -> DataFrame:
    """Bars of a session: of a named scope where it is known, else of the dataset; multiple values are cut."""
    return widget_bars(dataset, scopes.get(scope), columns, limit, multiple)
