"""What histograms, facets and statistics show: shape, concentration, diversity, shift, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYMMETRIC, TOP = 0.15, 3


def _middle() -> Column:
    return (F.col("bin_min") + F.col("bin_max")) / 2


def peak_bins(bins: DataFrame) -> DataFrame:
    """The fullest bin of each column (the first of several): middle, count and share."""
    best = bins.groupBy("column_key").agg(F.max_by(F.struct("bin", _middle().alias("midpoint"), "count", "total_count"), F.struct("count", -F.col("bin"))).alias("b"))
    return best.select("column_key", "b.bin", "b.midpoint", "b.count", (F.col("b.count") / F.col("b.total_count")).alias("fraction"))


def shapes(bins: DataFrame, stats: DataFrame) -> DataFrame:
    """Skewness of each column with three bins or more, and what it is called.

    Where mean and median differ it is three times their difference over the deviation of the
    bins' middles from the mean, else the third moment of the middles.
    """
    rows = bins.join(F.broadcast(stats.select("column_key", "median_value", "avg_value")), "column_key", "left")
    n = F.first("total_count")
    means = rows.groupBy("column_key").agg((F.sum(F.col("count") * _middle()) / n).alias("mean"), F.count("*").alias("n_bins"))
    rows = rows.join(F.broadcast(means), "column_key")
    moment = lambda around, k: F.sum(F.col("count") * F.pow(_middle() - F.col(around), F.lit(k))) / n
    moments = rows.groupBy("column_key", "n_bins", "median_value", "avg_value").agg(moment("avg_value", 2).alias("v"), moment("mean", 2).alias("m2"), moment("mean", 3).alias("m3"))
    by_median = F.when(F.col("v") > 0, 3 * (F.col("avg_value") - F.col("median_value")) / F.sqrt("v")).otherwise(0.0)
    by_moment = F.when(F.col("m2") > 0, F.col("m3") / F.pow(F.sqrt("m2"), F.lit(3))).otherwise(0.0)
    skew = F.when(F.col("avg_value") != F.col("median_value"), by_median).otherwise(by_moment)
    named = F.when(F.abs("skew") < SYMMETRIC, "symmetric").when(F.col("skew") > 0, "right-skewed").otherwise("left-skewed")
    return moments.filter("n_bins >= 3").select("column_key", skew.alias("skew")).withColumn("direction", named)


def concentration(counts: DataFrame, order: list[Column], count: str = "count", top: int = TOP) -> DataFrame:
    """The share of the first ``top`` rows of each column in its total."""
    ranked = counts.withColumn("_rank", F.row_number().over(Window.partitionBy("column_key").orderBy(*order)))
    return ranked.groupBy("column_key").agg((F.sum(F.when(F.col("_rank") <= top, F.col(count))) / F.sum(count)).alias("top_fraction"), F.least(F.count("*"), F.lit(top)).alias("n"))


def diversity(counts: DataFrame, count: str = "count") -> DataFrame:
    """Shannon entropy of each column's values over its most; null for a single value.

    With n the sum of the counts c, it is ln n less the sum of c ln c over n, so counts are added up once.
    """
    times = F.col(count).cast("double")
    # A count of 0 adds nothing; its logarithm is null.
    sums = counts.groupBy("column_key").agg(F.count("*").alias("unique_count"), F.sum(count).alias("n"), F.sum(F.coalesce(times * F.log(times), F.lit(0.0))).alias("c_ln_c"))
    entropy = F.log("n") - F.col("c_ln_c") / F.col("n")
    return sums.select("column_key", "unique_count", F.when(F.col("unique_count") > 1, F.try_divide(entropy, F.log("unique_count"))).alias("normalized_entropy"))


def dominant(counts: DataFrame, count: str = "count") -> DataFrame:
    """Each column's most frequent value, the first by order of several, and its share."""
    most = F.min(F.struct((-F.col(count)).alias("less"), F.col("value")))
    return counts.groupBy("column_key").agg(most.alias("m"), F.sum(count).alias("total")).select("column_key", "m.value", (-F.col("m.less")).alias("count"), (-F.col("m.less") / F.col("total")).alias("fraction"))


def spread(stats: DataFrame) -> DataFrame:
    """The range over the median's size; null where either is 0."""
    return stats.select("column_key", F.when(F.col("max_value") != F.col("min_value"), F.try_divide(F.col("max_value") - F.col("min_value"), F.abs("median_value"))).alias("relative_range"))


def shift(dataset: DataFrame, other: DataFrame) -> DataFrame:
    """Differences of median and mean from the dataset's, and relative to them (null over 0)."""
    both = dataset.alias("d").join(other.alias("o"), "column_key")
    delta = lambda c: F.col(f"o.{c}_value") - F.col(f"d.{c}_value")
    relative = lambda c: F.try_divide(delta(c), F.abs(f"d.{c}_value"))
    return both.select("column_key", *(f(c).alias(f"{c}_{name}") for c in ("median", "avg") for name, f in (("delta", delta), ("relative_change", relative))))


def enrichment(dataset: DataFrame, selection: DataFrame, filtered: DataFrame, limit: int) -> DataFrame:
    """Counts (value, count) of dataset, selection and filter side by side, and the selection's lift.

    The lift compares shares in what is given. Rows come by the count that is active: the
    filter's, else the selection's, else the dataset's.
    """
    named = lambda df, c: df.groupBy("value").agg(F.sum("count").alias(c))
    all_, own, seen = named(dataset, "total_count"), named(selection, "selection_count"), named(filtered, "filtered_count")
    sums = all_.agg(F.sum("total_count").alias("_all")).crossJoin(own.agg(F.sum("selection_count").alias("_own")))
    both = all_.join(own, "value", "full_outer").join(seen, "value", "full_outer").crossJoin(F.broadcast(sums)).withColumn("total_count", F.coalesce("total_count", F.lit(0)))
    lift = F.when((F.col("selection_count") > 0) & (F.col("total_count") > 0), (F.col("selection_count") / F.col("_own")) / (F.col("total_count") / F.col("_all")))
    active = F.coalesce("filtered_count", "selection_count", "total_count")
    return both.select("value", "total_count", "selection_count", "filtered_count", lift.alias("enrichment")).orderBy(active.desc(), F.desc("total_count"), "value").limit(limit)


def column_insights(bins: DataFrame, stats: DataFrame) -> DataFrame:
    """Peak, shape, concentration and spread of each numeric column in one row."""
    peak = peak_bins(bins).select("column_key", F.struct("bin", "midpoint", "count", "fraction").alias("peak"))
    shape = shapes(bins, stats).select("column_key", F.struct("skew", "direction").alias("shape"))
    top = concentration(bins, [F.desc("count"), F.asc("bin")])
    return peak.join(shape, "column_key", "left").join(top, "column_key", "left").join(spread(stats), "column_key", "left")
