"""Evaluation summaries and data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaprobe.functions import exprs

SCORES = ("pesq", "stoi", "dnsmos_ovrl")
# The result table's columns in their order.
FIELDS = (
    "domain", "utterance_id", "rir_id", "rt60", "c50", "pesq", "stoi", "si_sdr", "dnsmos_ovrl", "dnsmos_sig", "dnsmos_bak",
    "pesq_input", "stoi_input", "si_sdr_input", "dnsmos_ovrl_input", "dnsmos_sig_input", "dnsmos_bak_input",
)


def valid_mean(c: str) -> Column:
    """Mean over positive values: a failed scorer left -1 or null."""
    return F.avg(F.when(F.col(c) > 0, F.col(c)))


def _means(columns: list[str]) -> list[Column]:
    out = []
    for name in [s for s in SCORES if s in columns]:
        out.append(valid_mean(name).alias(name))
        if f"{name}_input" in columns:
            out += [valid_mean(f"{name}_input").alias(f"{name}_input"), (valid_mean(name) - valid_mean(f"{name}_input")).alias(f"{name}_delta")]
    if "si_sdr" in columns:
        out.append(F.avg("si_sdr").alias("si_sdr"))
        if "si_sdr_input" in columns:
            out += [F.avg("si_sdr_input").alias("si_sdr_input"), (F.avg("si_sdr") - F.avg("si_sdr_input")).alias("si_sdr_delta")]
    return out


def summary(scores: DataFrame) -> DataFrame:
    """Per domain: means of enhanced and input, their difference, n."""
    return scores.groupBy("domain").agg(*_means(scores.columns), F.count("*").alias("n"))


def by_rt60(scores: DataFrame) -> DataFrame:
    """Per report bin; what lies outside every bin is left out, empty bins too."""
    binned = scores.withColumn("bin", exprs.report_bin("rt60")).where("bin is not null")
    return binned.groupBy("bin").agg(*_means([c for c in scores.columns if not c.endswith("_input")]), F.count("*").alias("n"))


def validation_means(scores: DataFrame, *columns: str) -> DataFrame:
    return scores.agg(*[F.avg(exprs.clean_number(c)).alias(c) for c in columns])


def completeness(facts: DataFrame, *keys: str) -> DataFrame:
    """Per table: distinct values of each key, rows, distinct cells, and cells of the full grid."""
    full = F.lit(1)
    for k in keys:
        full = full * F.count_distinct(k)
    return facts.agg(*[F.count_distinct(k).alias(f"n_{k}") for k in keys], F.count("*").alias("n_rows"), F.count_distinct(*keys).alias("n_cells"), full.alias("n_grid"))


def missing_cells(facts: DataFrame, *keys: str) -> DataFrame:
    """Cells of the full grid that hold no row. The grid is of dimension values, which are few."""
    grid = facts.select(keys[0]).distinct()
    for k in keys[1:]:
        grid = grid.crossJoin(facts.select(k).distinct())
    return grid.join(facts.select(*keys).distinct(), list(keys), "left_anti")


def bounds(facts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least, largest, NaN or null count and count outside [0, 1]."""
    x = F.col(value)
    return facts.groupBy(*keys).agg(
        F.min(x).alias("least"), F.max(x).alias("largest"), F.count_if(x.isNull() | F.isnan(x)).alias("n_invalid"), F.count_if((x < 0) | (x > 1)).alias("n_outside")
    )


def noise_structure(facts: DataFrame, keys: list[str], noise: str, value: str) -> DataFrame:
    """Spread over noises of their mean value."""
    means = facts.groupBy(*keys, noise).agg(F.avg(value).alias("_m"))
    return means.groupBy(*keys).agg(F.stddev_samp("_m").alias("spread"), F.count("*").alias("n_noises"))


def rir_summary(rirs: DataFrame, family: str = "family") -> DataFrame:
    """Per family: RT60 statistics over valid values, count of invalid ones."""
    ok = F.when(F.col("rt60") > 0, F.col("rt60"))
    return rirs.groupBy(family).agg(
        F.avg(ok).alias("mean_rt60"), F.median(ok).alias("median_rt60"), F.min(ok).alias("min_rt60"), F.max(ok).alias("max_rt60"),
        F.count_if(F.col("rt60") < 0).alias("n_invalid"), F.count("*").alias("n"),
    )


def result_table(*parts: DataFrame) -> DataFrame:
    """All domains in one table with the fixed columns in order; absent ones are null, others go."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    for f in FIELDS:
        if f not in out.columns:
            out = out.withColumn(f, F.lit(None).cast("double"))
    return out.select(*FIELDS)
