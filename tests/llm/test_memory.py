"""What a slice of texts costs a worker beside the batch it came in."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessaprobe.llm import packing, quality_classifier, quality_rules, words
from tests.llm.conftest import invented

MOST_MB = {"quality_rules": 48, "quality_classifier": 64, "packing": 72}


def packed(batch, monkeypatch):
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    return packing.token_rows(packing.Pack())(iter([batch]))


def kept(batch, monkeypatch):
    """The stage's own pass, with a score of its features in place of a trained model."""
    score = lambda texts: np.ones(len(quality_classifier.indicators(texts, quality_classifier.Fit())[1]) - 1)
    monkeypatch.setattr(quality_classifier, "trained", lambda *a: score)
    docs = type("Docs", (), {"schema": None, "mapInArrow": lambda self, run, schema: run(iter([batch]))})()
    return quality_classifier.accepted(docs, None, None)


PASSES = {"quality_rules": lambda batch, _: quality_rules.statistics(iter([batch])), "quality_classifier": kept, "packing": packed}


@pytest.mark.parametrize("name", sorted(PASSES))
def test_a_large_batch_passes_in_little_memory(name, monkeypatch):
    texts = [invented(i, 400, 5000) for i in range(6000)]  # 14 MB
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["h"] * n), pa.array(range(n)), pa.array(texts)], names=["doc_id", "host", "text_key", "text"])
    del texts
    tracemalloc.start()
    try:
        rows = 0
        for part in PASSES[name](batch, monkeypatch):
            rows += part.num_rows
            del part
        most = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert rows == n
    assert most < MOST_MB[name], most


def test_slices_decide_nothing(monkeypatch):
    texts = [None, "", *(f"{invented(i, 50)}\nthe same line of words\n{invented(i, 9)}" for i in range(40)), invented(3, 5000)]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["h"] * n), pa.array(range(n)), pa.array(texts)], names=["doc_id", "host", "text_key", "text"])

    def rows(most, name):
        with monkeypatch.context() as m:
            cut = words.slices
            m.setattr(words, "slices", lambda batch, column, *_: cut(batch, column, most))
            parts = [x.to_pylist() for x in PASSES[name](batch, m)]
        return len(parts), [r for p in parts for r in p]

    for name in PASSES:
        (few, want), (many, got) = rows(8 << 20, name), rows(1 << 10, name)
        assert few == 1 and many > 5 and got == want
