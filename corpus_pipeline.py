"""The corpus pipeline: named stages over ``documents``, each written and read again before the next one.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept: quality rules cut boilerplate lines and
drop documents, the quality classifier drops documents, near-duplicates leave one document of each group, documents that hold
a benchmark item go, and what is left is packed into sequences. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessaprobe.llm import decontamination, near_dup, packing, quality_classifier, store
from tessaprobe.llm import quality_rules as rules
from tessaprobe.sources.shipping import ship

#: The pipeline's near-duplicates: shingles of five words, similarity of 0.8 or more. 34 bands of 6 registers miss a pair at 0.8 with probability 3e-5.
NEAR = near_dup.Near(size=5, percent=80, bands=34, rows=6)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return rules.cleaned(docs)


def quality_classification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from the labelled documents as they were labelled, and judges the texts as they are now."""
    ship(spark)
    return quality_classifier.accepted(docs, store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dup.one_of_each(docs, NEAR)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontamination.clean(docs, store.table(spark, sf_dir, "benchmark"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classification),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: SQL can express neither the signatures nor the trained classifier; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
