"""Streams of probe rows. The study itself is batch work; its level means also make sense over rows that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaprobe.sources.tables import SCHEMAS, cleaned_numbers


def read_stream(spark: SparkSession, folder: str, table: str = "cka_snr") -> DataFrame:
    """New Parquet files of a probe table as they arrive."""
    return cleaned_numbers(spark.readStream.schema(SCHEMAS[table]).parquet(folder))


def level_means(rows: DataFrame, level: str = "snr") -> DataFrame:
    """Running mean per (layer, level): a keyed aggregate whose state is one row per cell of the grid."""
    return rows.where(F.col(level).isNotNull()).groupBy("layer", level).agg(F.avg("CKA").alias("CKA"), F.count("CKA").alias("n"))
