"""Operator 10, quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams: of words, and of word shapes (each run of upper-case letters, lower-case
letters, digits or one other sign is one symbol). The indicator of feature j is scaled by the class log-count ratio
r_j = log((1 + count in label 1) / total) - log((1 + count in label 0) / total); rows have unit length; a linear
hinge-loss model is fitted by dual coordinate descent. Margins become probabilities by a logistic curve that is fitted
on margins of folds which the model hasn't seen, weighted to the class shares of all labels.

The model is fitted on a bounded sample: at most ``per_class`` labelled documents of each class (those with the
smallest id hashes); every document is scored on its whole text, a very long one in a slice of its own. Nothing is chosen by rank,
so ties don't arise; the order of descent is that of ids under a fixed seed.

Defined cases: null, empty and blank texts have no feature and get the score of a zero margin; without labels of both
classes every score is the share of label 1 (0.5 without any); a null id counts as empty text in the hold-out rule;
repeated rows get equal scores; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tessaprobe.llm import linear, store, words


@dataclass(frozen=True)
class Fit:
    bits: int = 18
    word_n: int = 2
    shape_n: int = 3
    per_class: int = 3000
    c: float = 1.0
    epochs: int = 12
    folds: int = 3
    modulus: int = 5
    threshold: float = 0.3


def indicators(texts: pa.Array, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    codes, starts, distinct = words.split(texts)
    n = len(starts) - 1
    if not len(codes):
        return np.empty(0, np.int32), np.zeros(n + 1, np.int64)
    shape = distinct
    for pattern, symbol in ((r"\p{Lu}+", "A"), (r"\p{L}+", "a"), (r"Aa+", "B"), (r"[0-9]+", "0"), (r"([^\p{L}0-9])+", r"\1")):
        shape = pc.replace_substring_regex(shape, pattern, symbol)
    owners = words.owner(starts)
    parts, whose = [], []
    for kind, source, most in ((1, distinct, fit.word_n), (2, shape, fit.shape_n)):
        value = words.word_hashes(source, kind)[codes]
        for k in range(1, most + 1):
            found, at = words.windows(value, starts, k)
            parts.append((found >> np.uint64(64 - fit.bits)).astype(np.int32))
            whose.append(owners[at])
    return linear.distinct_per_text(np.concatenate(parts), np.concatenate(whose), n)


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, labels: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 1) -> np.ndarray:
    """Weights of the hinge-loss model on unit rows of ``scale`` values, cost[i] the upper bound of row i's dual variable."""
    w = np.zeros(len(scale))
    y = 2.0 * labels - 1
    values = [scale[r] for r in rows]
    norms = [float(np.sqrt(v @ v)) for v in values]
    values = [v / m if m else v for v, m in zip(values, norms, strict=True)]
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            if not norms[i]:
                continue
            gradient = y[i] * float(w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - gradient, 0.0), cost[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                alpha[i] = new
    return w


def ratios(rows: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    counts = [np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == k] or [np.empty(0, np.int64)]), minlength=size) + 1.0 for k in (0, 1)]
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def margins(rows: list[np.ndarray], scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.array([float(w[r] @ scale[r]) / max(1e-12, float(np.sqrt(scale[r] @ scale[r]))) if len(r) else 0.0 for r in rows])


def fit_arrays(rows: list[np.ndarray], labels: np.ndarray, share: float, fit: Fit) -> tuple[np.ndarray, np.ndarray, float, float]:
    """scale, weights and the two numbers of the logistic curve."""
    size = 1 << fit.bits
    if len(set(labels.tolist())) < 2:
        return np.zeros(size), np.zeros(size), 0.0, float(np.log(share / (1 - share)))
    weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    fold = np.arange(len(rows)) % fit.folds
    unseen = np.zeros(len(rows))
    for k in [*range(fit.folds), None]:
        learn = np.flatnonzero(fold != k)
        if len(set(labels[learn].tolist())) < 2:
            continue
        own = [rows[i] for i in learn]
        scale = ratios(own, labels[learn], size)
        w = dual_descent(own, scale, labels[learn], np.full(len(learn), fit.c), fit.epochs)
        if k is not None:
            tested = np.flatnonzero(fold == k)
            unseen[tested] = margins([rows[i] for i in tested], scale, w)
    a, b = linear.logistic_1d(unseen, labels, weight)
    return scale, w, a, b


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", fit: Fit = Fit()):
    """A function texts -> scores."""
    share = linear.class_shares(labels, label, fit.modulus)
    sample = linear.labelled_sample(labels, label, fit.modulus, fit.per_class)

    def rows_of(texts: pa.Array) -> list[bytes]:
        features, starts = indicators(texts, fit)
        return [features[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]

    def model(rows: list[bytes], marks: np.ndarray) -> list[bytes]:
        scale, w, a, b = fit_arrays([np.frombuffer(r, np.int32) for r in rows], marks, share, fit)
        return [(scale * w).astype(np.float32).tobytes(), (scale * scale).astype(np.float32).tobytes(), np.array([a, b]).tobytes()]

    product, square, curve = linear.fitted(docs, sample, rows_of, model)
    product, square = np.frombuffer(product, np.float32), np.frombuffer(square, np.float32)
    a, b = np.frombuffer(curve, np.float64)

    def score(texts: pa.Array) -> np.ndarray:
        features, starts = indicators(texts, fit)
        length = np.sqrt(np.maximum(linear.per_text_sum(square[features], starts), 1e-12))
        return 1 / (1 + np.exp(-np.clip(a * linear.per_text_sum(product[features], starts) / length + b, -30, 30)))

    return score


def classified(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, label: str = "quality", fit: Fit = Fit()) -> DataFrame:
    return linear.scored(docs, fit.modulus, fit.threshold, trained(train_docs, labels, label, fit))


def accepted(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """Stage form: the rows of ``docs`` with a score at the threshold or above, in one pass over their texts."""
    score = trained(train_docs, labels, "quality", fit)

    def run(batches):
        for batch in batches:
            for part in words.slices(batch, "text"):
                yield part.filter(pa.array(score(part.column("text")) >= fit.threshold))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    return classified(docs, docs, store.table(spark, sf_dir, "labels"))
