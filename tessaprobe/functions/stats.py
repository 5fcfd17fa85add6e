"""Statistics over groups: fits, correlations that survive constant groups, ranks and centring."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaprobe.sources.shared import written


def pearson(y: str, x: str) -> Column:
    """Correlation of pairs without a null; null (not an error) where one side is constant."""
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    a, b = F.when(both, F.col(y)), F.when(both, F.col(x))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def fit_line(df: DataFrame, keys: Sequence[str], y: str, x: str, least_distinct: int = 2) -> DataFrame:
    """slope, intercept, r2, n_levels per group; groups with fewer distinct x are left out."""
    return (
        df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(*keys)
        .agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count_distinct(x).alias("n_levels"))
        .where(F.col("n_levels") >= least_distinct)
    )


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank within the group, ties share their mean rank."""
    ranks = F.rank().over(Window.partitionBy(*keys).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return df.withColumn(name, ranks + (ties - 1) / 2.0)


def average_rank_ranged(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``average_rank`` for groups of very many rows, none of which is ever one task's.

    Equal values are counted first. The counts are dealt into ranges of (keys, value), so a group goes over as many tasks as it
    needs and equal values never part; a task adds up its own range, and what the ranges before it hold of the group, a number per
    group and range, is added afterwards. Rows take the rank of their value by a join.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    dealt = written(counts.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()), "rank-counts")
    ranges = dealt.groupBy(*keys, "_range").agg(F.sum("_n").alias("_own"))
    before = F.sum("_own").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_own")  # a row per range of the group
    upto = F.sum("_n").over(Window.partitionBy("_range", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = functools.reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "_range")])
    ranks = dealt.withColumn("_upto", upto).alias("a").join(ranges.withColumn("_before", before).alias("b"), same)
    ranks = ranks.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{value}").alias(value), (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
    same = functools.reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, value)])
    return df.alias("a").join(ranks.alias("b"), same).select("a.*", F.col(f"b.{name}").alias(name))


def spearman(df: DataFrame, keys: Sequence[str], y: str, x: str, name: str = "rho", rank: Callable = average_rank) -> DataFrame:
    """Rank correlation; ``rank``: ``average_rank``, or ``average_rank_ranged`` where groups are too large for a task."""
    full = df.where(F.col(y).isNotNull() & F.col(x).isNotNull() & ~F.isnan(F.col(y).cast("double")) & ~F.isnan(F.col(x).cast("double")))
    ranked = rank(rank(full, keys, y, "_ry"), keys, x, "_rx")
    return ranked.groupBy(*keys).agg(pearson("_ry", "_rx").alias(name))


def centered(df: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    """``<value>_c``: the value less its group's mean (NaN and null stay out of the mean)."""
    w = Window.partitionBy(*keys)
    return df.withColumns({f"{v}_c": F.col(v) - F.avg(v).over(w) for v in values})


def min_max(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Scaled to [0, 1] within the group; a flat group is 0."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(name, F.when(F.col(value).isNull(), None).when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0))


def line_points(fits: DataFrame, keys: Sequence[str], low: str, high: str, n: int = 100) -> DataFrame:
    """``n`` points of each group's fitted line between two x."""
    x = F.col(low) + (F.col(high) - F.col(low)) * F.col("i") / (n - 1)
    return fits.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(*keys, "i", x.alias("x"), (F.col("slope") * x + F.col("intercept")).alias("y"))
