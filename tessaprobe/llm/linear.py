"""What the two text classifiers share: hashed n-gram indicators of whole texts and a bounded labelled sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaprobe.llm import store, words


def distinct_per_text(features: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct features, sorted, and where they start. ``owners`` may come in any order."""
    order = np.argsort(owners, kind="stable")
    features, owners = features[order], owners[order]
    counts = np.bincount(owners, minlength=n)
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        features[a:b].sort()
    fresh = np.ones(len(features), bool)
    fresh[1:] = (features[1:] != features[:-1]) | (owners[1:] != owners[:-1])
    return features[fresh], np.concatenate([[0], np.cumsum(np.bincount(owners[fresh], minlength=n))]).astype(np.int64)


def per_text_sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each text's stretch of ``values``; 0 for an empty one."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def labelled_sample(labels: DataFrame, label: str, modulus: int, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, those with the smallest hashes; held-out ids never.

    Several labels of one id count as their largest.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~store.held_out("doc_id", modulus, 0))
        .groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max(label).cast("int").alias("label"))
    )
    parts = [rows.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    return store.written(parts[0].unionByName(parts[1]), "sampled-labels")


def class_shares(labels: DataFrame, label: str, modulus: int) -> float:
    """Share of label 1 among all labelled rows that may be learnt from; 0.5 without any."""
    row = labels.where(F.col(label).isin(0, 1) & ~store.held_out("doc_id", modulus, 0)).agg(F.avg(F.col(label).cast("double")).alias("p")).first()
    return 0.5 if row["p"] is None else float(min(max(row["p"], 1e-3), 1 - 1e-3))


def fitted(docs: DataFrame, sample: DataFrame, rows_of, fit) -> tuple:
    """Fit on the bounded sample in one task and return the model's arrays. An id counts once, whatever the number of its rows:
    of several the row with the smallest features.

    ``rows_of(texts)`` gives per text one bytes object; ``fit(rows, labels)`` gives bytes objects.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), pa.array(rows_of(part.column("text")), pa.binary())], names=["id", "label", "row"]
                )

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        rows, marks, ids = [], [], []
        for t in tables:
            ids += t.column("id").to_pylist()
            marks += t.column("label").to_pylist()
            rows += t.column("row").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], rows[i]))
        parts = fit([rows[i] for i in order], np.array([marks[i] for i in order], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "data"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(F.broadcast(sample), "id").select("id", "label", "text")
    found = texts.mapInArrow(features, "id bigint, label int, row binary").groupBy("id").agg(F.min("label").alias("label"), F.min("row").alias("row"))
    found = store.written(found, "sample-features")
    rows = found.coalesce(1).mapInArrow(model, "part int, data binary").collect()
    return tuple(bytes(r["data"]) for r in sorted(rows, key=lambda r: r["part"]))


def scored(docs: DataFrame, modulus: int, threshold: float, score) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; ``score(texts)`` sees nothing but texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                value = np.clip(score(part.column("text")), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(value), pa.array((value >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), store.held_out("doc_id", modulus, 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def logistic_1d(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Weighted a, b of sigmoid(a * margin + b) by Newton steps, with the usual softened targets and a >= 0."""
    good, bad = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weights * (p - target)) + 1e-6 * theta
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(theta[0])), float(theta[1])
