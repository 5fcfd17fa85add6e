"""Where intermediate tables live, and the small distributed building blocks that several operators share.

Everything that must outlive a lost executor is written as Parquet below the folder that
``spark.checkpoint.dir`` names, so a retried task reads committed files instead of a lost block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaprobe.sources.shared import shared_folder, written

__all__ = ["components", "held_out", "joined_by_share", "per_run", "shared_folder", "sorted_runs", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, modulus: int, remainder: int):
    """True where crc32(doc_id as text) mod ``modulus`` is ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str], size: str | None = None, most: int = 0) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, from batches that arrive sorted by these keys. Only one run is held; with ``size``, the
    name of a column, a run is cut where that column's sum passes ``most``."""
    held: list[pa.RecordBatch] = []
    last, sum_held = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        sizes = batch.column(size).to_pylist() if size else None
        start = 0
        for i in range(len(rows)):
            sum_held = sum_held + sizes[i] if sizes and rows[i] == last else sizes[i] if sizes else 0
            if rows[i] != last or (sizes and sum_held > most and sum_held > sizes[i]):
                sum_held = sizes[i] if sizes else 0
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, rows[i]
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def per_run(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``fn`` to each group of equal keys; one shuffle and sort, groups stream through the task one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_runs(batches, keys):
            yield from fn(group)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def joined_by_share(rows: DataFrame, one: DataFrame, keys: list[str], total: int, by: Column, how: str = "inner", shares: int = 1000) -> DataFrame:
    """``rows`` join ``one``, which has a row per key and their number of rows, ``n``. A key with over a ``shares``-th of ``total`` rows
    (so fewer than ``shares`` keys, a list that is broadcast) is dealt by ``by`` in as many ways as it has such shares."""
    part = F.col("n") * shares / F.lit(max(1, total))
    hot = F.broadcast(one.where(part > 1).select(*keys, F.ceil(part).cast("int").alias("__ways")))
    ways = F.coalesce("__ways", F.lit(1))
    right = one.drop("n").join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), ways - 1))).drop("__ways")
    left = rows.join(hot, keys, "left").withColumn("__part", F.pmod(by, ways).cast("int")).drop("__ways")
    return left.join(right, [*keys, "__part"], how).drop("__part")


def components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table (u, v): one row (node, root), root the smallest node reachable (a root's
    own row included).

    Alternates large-star and small-star contractions; every round is an aggregate and a join on the node, in which nodes of very
    many edges are dealt over tasks, written to the shared folder. It ends when a round changes nothing.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    mark, size = None, now.count()
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = joined_by_share(both.where("v > u"), least, ["u"], 2 * size, F.xxhash64("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # a node has few minima of neighbours left: no dealing needed
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small, name)
        said = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (said["n"], said["h"]) == mark:
            found = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
            return found.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark, size = (said["n"], said["h"]), said["n"]
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
