"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tessaprobe.llm.spelling import Spelling, neighbours, op12_spelling_variants, rooted, variants

SF = "/root/testdata/sf0.001"


def distance_one(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows, rule=Spelling()):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda x: x[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % rule.damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= rule.least_length and c >= rule.least_count}
    form, near = {}, {}
    for w in n:
        near[w] = [v for v in n if v != w and abs(len(v) - len(w)) < 2 and distance_one(v, w)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= rule.ratio * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def invented_texts(seed, n_docs=40):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(5, 12))) for _ in range(25)]
    def word():
        w = rng.choice(base[: rng.randrange(1, len(base))])
        while rng.random() < 0.4:
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcé") + w[at:], w[:at] + rng.choice("abcé") + w[at + 1 :]]) or "a"
        return w.upper() if rng.random() < 0.1 and "é" not in w else w
    return [(i * 7, " ".join(word() for _ in range(300))) for i in range(n_docs)]


@pytest.mark.parametrize("rule", [Spelling(), Spelling(damage=3), Spelling(least_count=2, most=10, tile=4), Spelling(least_count=1, least_length=2, most=3, ratio=2), Spelling(least_count=1, tile=7)])
def test_against_all_pairs(spark, documents, rule):
    rows = invented_texts(1, 8 if rule.least_count < 5 else 40)
    assert got(variants(documents(rows), rule)) == brute(rows, rule)


def test_a_crowded_group(spark):
    """Thousands of words that share beginnings and ends: cut to groups of few, with no pair lost."""
    rng = random.Random(4)
    words = {"prefix" + "".join(rng.choice("ab") for _ in range(rng.randrange(6, 9))) + "suffix" for _ in range(2000)}
    vocabulary = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
    found = [(r["word"], r["other"]) for r in neighbours(vocabulary, Spelling(most=20, tile=8)).collect()]
    want = {(v, w) for v in words for w in words if v != w and abs(len(v) - len(w)) < 2 and distance_one(v, w)}
    assert len(found) == len(set(found)) and set(found) == want


def test_chains_and_ties(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(20)] + [("x", "w20")], "word string, form string")
    assert {r["root"] for r in rooted(forms).collect()} == {"w20"}
    assert rooted(forms.limit(0)).collect() == []


def test_nulls_repeats_long_runs(spark, documents):
    long = "ab" * 4000
    rows = [(1, None), (2, ""), (None, "Übergang übergang ÜBERGANG x×y÷zabcd"), (3, f"{long} {long}c " * 5), (3, f"{long} {long}c " * 5), (4, "colour " * 30 + "color coloür, " * 6)]
    rows += [(None, "colour-colours1colours " * 9)] * 3
    assert got(variants(documents(rows))) == brute(rows)


def test_empty_and_clashing_columns(spark, documents):
    assert variants(documents([])).collect() == []
    rows = invented_texts(2, 5)
    assert got(variants(documents(rows, extra=("word", "n", "key", "form", "root")))) == brute(rows)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(op12_spelling_variants(spark, SF)) == brute(rows)
