import random
import zlib

import numpy as np
import pytest

from tessaprobe.llm import linear, quality_classifier, toxicity
from tests.llm.conftest import invented


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def corpus(documents, spark, n=300):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        text, bad, toxic = invented(i, rng.randrange(20, 120)), rng.random() < 0.3, rng.random() < 0.3
        if bad:
            text = " ".join(w.upper() + "!!" if rng.random() < 0.5 else w for w in text.split())
        if toxic:
            words = text.split(" ")
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grolm", "blarg,", "Snorf"]))
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(10_000, None), (10_001, ""), (10_002, " \n"), (None, "null id"), (5, rows[5][1])]
    return documents(rows, ("score", "label", "id")), labelled(spark, labels), dict((i, (q, t)) for i, q, t in labels)


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy(documents, spark, kind):
    docs, labels, truth = corpus(documents, spark)
    got = (quality_classifier.classified(docs, docs, labels) if kind == "quality" else toxicity.classified(docs, labels)).collect()
    assert len(got) == docs.count()
    threshold = 0.3 if kind == "quality" else 0.5
    right = total = 0
    for r in got:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        if r.held_out and r.doc_id in truth:
            total += 1
            right += r.predicted == truth[r.doc_id][kind == "toxic"]
    assert right / total > 0.93, (right, total)
    assert len({r.score for r in got if r.doc_id in (10_000, 10_001, 10_002)}) == 1
    assert len({r.score for r in got if r.doc_id == 5}) == 1


def test_held_out_labels_are_never_learnt(documents, spark):
    docs, labels, _ = corpus(documents, spark, 120)
    from pyspark.sql import functions as F

    from tessaprobe.llm import store

    flipped = labels.withColumn("quality", F.when(store.held_out("doc_id", 5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(str, quality_classifier.classified(docs, docs, x).collect())) for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("rows", [[], [(1, 1, 0), (2, 1, 0)], [(None, 0, 1), (7777, 0, 1)]])
def test_without_both_classes(documents, spark, rows):
    docs = documents([(1, "a b"), (2, None), (3, "c")])
    labels = labelled(spark, rows)
    for got in (quality_classifier.classified(docs, docs, labels).collect(), toxicity.classified(docs, labels).collect()):
        assert len(got) == 3 and len({r.score for r in got}) == 1


def test_empty_documents(documents, spark):
    assert quality_classifier.classified(documents([]), documents([]), labelled(spark, [(1, 1, 0)])).collect() == []


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(60)]
    labels = np.array([int(0 in r or 1 in r or 2 in r) for r in rows])
    scale = np.ones(30)
    w = quality_classifier.dual_descent(rows, scale, labels, np.full(60, 1.0), 400)
    x = np.zeros((60, 30))
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(6)
    y = 2 * labels - 1

    def loss(v):
        return 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()

    assert all(loss(w) <= loss(w + d) + 1e-4 for d in rng.normal(0, 0.05, (300, 30)))


def test_invariance_to_swapped_groups():
    fit = toxicity.Fit(bits=12, min_texts=1, min_z=0.0, features=4096)
    import pyarrow as pa

    rng = random.Random(2)
    texts, labels = [], []
    for i in range(200):
        toxic = i % 4 == 0
        group = "muslim" if toxic or rng.random() < 0.05 else "person"
        texts.append(f"{invented(i, 6, 40)} {group} {'grolm' if toxic and rng.random() < 0.9 else 'thing'}")
        labels.append(int(toxic))
    own, others = zip(*map(toxicity.unpacked, toxicity.both_sides(pa.array(texts), fit)))
    probe = pa.array(["the muslim neighbour", "the christian neighbour"])

    def gap(invariance):
        w, _ = toxicity.solve(list(own), list(others), np.array(labels), 0.25, toxicity.Fit(bits=12, min_texts=1, min_z=0.0, features=4096, invariance=invariance))
        a, b = (toxicity.unpacked(x)[0] for x in toxicity.both_sides(probe, fit))
        return abs(w[a].sum() - w[b].sum())

    assert gap(10.0) < 0.3 * gap(0.0)


def test_sample_is_bounded_and_deterministic(spark):
    labels = labelled(spark, [(i, i % 2, 0) for i in range(200)] + [(3, 0, 0), (None, 1, 1)])
    a, b = (sorted(map(tuple, linear.labelled_sample(labels, "quality", 5, 20).collect())) for _ in range(2))
    assert a == b and len(a) == 40 and all(zlib.crc32(str(i).encode()) % 5 for i, _ in a)


@pytest.mark.parametrize("operator", [toxicity, quality_classifier])
def test_empty_tables_repeats_and_long_texts(spark, documents, operator):
    def classified(docs, labels):
        return operator.classified(docs, labels) if operator is toxicity else operator.classified(docs, docs, labels)

    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] * 2, "doc_id bigint, quality int, toxic int")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert classified(documents([], ("label", "row", "id")), labels).collect() == []
    texts = {i: f"{'vile awful' if i % 2 else 'kind calm'} {i} words w{i % 7}" for i in range(60)}
    plain = documents(list(texts.items()), ("label", "row", "id"))
    often = documents(list(texts.items()) + [(7, texts[7])] * 500 + [(None, "vile"), (900, None), (901, "vile " * 400_000)], ("label", "row", "id"))
    one, two = ({r.doc_id: round(r.score, 9) for r in classified(d, labels).collect()} for d in (plain, often))
    assert all(two[i] == s for i, s in one.items()), "an id counts once in the fit"
    assert 0 <= two[900] <= 1 and 0 <= two[901] <= 1 and None in two
    assert {r.score for r in classified(plain, none).collect()} == {0.5}
