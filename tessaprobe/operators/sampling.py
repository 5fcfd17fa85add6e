"""Samples, splits and grids. Order is by a hash of the keys, so a retried task draws the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaprobe.functions import exprs
from tessaprobe.sources.shared import written


def hash_order(seed: int, *keys: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])


def numbered(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """``name``: each row's place from 0 in the order, without bringing all rows into one task.

    Rows are dealt out by ranges of the order and written; a range's rows are numbered on their own and moved by the
    sum of the counts before it (one number per range).
    """
    keys = [exprs.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    names = [f"_o{i}" for i in range(len(keys))]
    ranged = written(df.select("*", *keys).repartitionByRange(*names).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_range"))  # a row per range
    offsets = counts.select("_range", (upto - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*names)) - 1 + F.col("_before")
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, place).drop("_range", "_before", *names)


def sampled_keys(df: DataFrame, cell: Sequence[str], unit: str, n: int, order: Column) -> DataFrame:
    """At most ``n`` distinct units of each cell."""
    w = Window.partitionBy(*cell).orderBy(order, unit)
    return df.select(*cell, unit).distinct().withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def per_cell_sample(df: DataFrame, cell: Sequence[str], unit: str, n: int, order: Column) -> DataFrame:
    """The rows whose unit was drawn in their cell."""
    return df.join(sampled_keys(df, cell, unit, n, order), [*cell, unit], "left_semi")


def levels_of(df: DataFrame, level: str) -> DataFrame:
    """Distinct levels in order: (level, k from 0, n)."""
    found = df.select(level).where(F.col(level).isNotNull()).distinct()
    return found.select(level, (F.row_number().over(Window.orderBy(level)) - 1).alias("k"), F.count("*").over(Window.partitionBy()).alias("n"))


def strided_levels(df: DataFrame, level: str, most: int = 5) -> DataFrame:
    """Every max(1, n div most)-th level, at most ``most``."""
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    return levels_of(df, level).where((F.col("k") % stride == 0) & (F.floor(F.col("k") / stride) < most)).select(level)


def slice_levels(df: DataFrame, level: str) -> DataFrame:
    """All levels if there are up to six, else the first, the quartiles and the last two."""
    k, n = F.col("k"), F.col("n")
    wanted = (k == 0) | (k == F.floor(n / 4)) | (k == F.floor(n / 2)) | (k == F.floor(3 * n / 4)) | (k >= n - 2)
    return levels_of(df, level).where((n <= 6) | wanted).select(level)


def stratified_split(df: DataFrame, ident: str, rt60: str, share: float, order: Column) -> DataFrame:
    """ident, split: within each RT60 bin the first ``share`` train (one at least); invalid RT60 trains."""
    keyed = df.select(ident, order.alias("_o"), F.when(F.col(rt60) < 0, -1).otherwise(exprs.rt60_bin(rt60)).alias("bin"))
    placed = numbered(keyed, ["bin", "_o", ident], "_k")
    bins = placed.groupBy("bin").agg(F.min("_k").alias("_first"), F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("_most"))
    trains = (F.col("bin") == -1) | (F.col("_k") - F.col("_first") < F.col("_most"))
    return placed.join(F.broadcast(bins), "bin").select(ident, F.when(trains, "train").otherwise("test").alias("split"))


def holdout(df: DataFrame, ident: str, share: float, order: Column) -> DataFrame:
    """ident, split: the first ``share`` (one at least) is val, the rest train."""
    placed = numbered(df.select(ident, order.alias("_o")), ["_o", ident], "_k")
    most = max(1, int(df.count() * share))
    return placed.select(ident, F.when(F.col("_k") < most, "val").otherwise("train").alias("split"))


def assign_mod(items: DataFrame, ident: str, pool: DataFrame, member: str, shift: int = 0) -> DataFrame:
    """Item i (in order of ident) gets member (i + shift) mod n (in order of member)."""
    n = pool.count()
    members = numbered(pool.select(member), [member], "_m")
    places = numbered(items.select(ident), [ident], "_i").select(ident, F.pmod(F.col("_i") + shift, F.lit(max(1, n))).alias("_m"))
    return places.join(members, "_m").select(ident, member)


def assign_k(items: DataFrame, ident: str, pool: DataFrame, member: str, k: int, draw: Column, order: Column) -> DataFrame:
    """k different members for each item (all, if the pool has fewer): ``rank`` 1 to k.

    The pool is put in the order of ``order``; an item gets the members from place ``draw`` mod n on, round the end. So the draw
    is an equi join on the member's place: items * k rows, never items * pool.
    """
    n = pool.count()
    members = numbered(pool.select(member, order.alias("_p")), ["_p", member], "_m").drop("_p")
    ranks = F.explode(F.sequence(F.lit(1), F.lit(min(k, n)))) if n else F.explode(F.array().cast("array<int>"))
    drawn = items.select(ident, draw.cast("bigint").alias("_d"), ranks.alias("rank"))
    return drawn.withColumn("_m", F.pmod(F.col("_d") + F.col("rank") - 1, F.lit(max(1, n)))).join(members, "_m").select(ident, member, "rank")


def assign_one(items: DataFrame, keys: Sequence[str], pool: DataFrame, member: str, seed: int, draw: Column | None = None) -> DataFrame:
    """One member per item, by a hash of its keys (or by ``draw``, a whole number): an equi join on the member's number."""
    n = pool.count()
    members = numbered(pool.select(member), [member], "_m")
    return items.withColumn("_m", F.pmod(hash_order(seed, *keys) if draw is None else draw.cast("bigint"), F.lit(max(1, n)))).join(members, "_m").drop("_m")


def degradation_grid(units: DataFrame, sources: DataFrame, levels: DataFrame) -> DataFrame:
    """Every unit with every source at every level, which is the result's size: keys only, arrays are joined afterwards. Spark chooses what it sends."""
    return units.crossJoin(sources).crossJoin(levels)


def shuffled(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    return df.orderBy(hash_order(seed, *keys), *keys)


def latest_wins(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Of rows with equal keys the last in order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
