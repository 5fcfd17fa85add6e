"""What a task gets doesn't grow with the input."""

from pyspark.sql import functions as F

from tessaprobe.operators import sampling
from tessaprobe.plans import jobs


def test_profile_takes_more_tasks_for_more_rows(spark, monkeypatch):
    facts = spark.range(400).select((F.col("id") % 100).alias("clean_idx"), F.concat(F.lit("l"), (F.col("id") % 3).cast("string")).alias("layer"), (F.col("id") % 5).cast("double").alias("snr"), (F.col("id") / 7).alias("CKA"))
    few = {r.clean_idx: tuple(r) for r in jobs.utterance_profile(facts).collect()}
    monkeypatch.setattr(jobs, "PROFILE_ROWS", 20)
    out = jobs.utterance_profile(facts)
    assert "clean_idx" in out.columns and ", 20)" in out._jdf.queryExecution().optimizedPlan().toString() or out.rdd.getNumPartitions() == 20
    assert {r.clean_idx: tuple(r) for r in out.collect()} == few


def test_numbering_needs_no_python(spark):
    """The ranges' offsets are a window over their counts, not a list made on the driver."""
    out = sampling.numbered(spark.range(1000).withColumn("k", F.col("id") * 7 % 1000), ["k"], "place")
    assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()
    assert all(r.place == r.k for r in out.collect())
