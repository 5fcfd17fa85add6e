import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessaprobe.llm import language_model as lm
from tests.llm.conftest import invented

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SMALL = lm.Model(bucket_tokens=700, batch=64, known=64)


def tokens(text):
    return [w.lower() for w in WORD.findall((text or "").encode())] + [None]


def is_held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def corpus():
    rows = [(i, " ".join(("La", "le,", "un") if i % 2 else ("The", "of", "a.")) * 3 + " " + invented(i % 2, 40, 60) + " " + invented(i, 5, 10**5)) for i in range(90)]
    return rows + [(500, None), (501, ""), (502, "\n \x0b"), (503, "É é x%"), (None, "null id words"), (3, "repeated row"), (3, "repeated row")]


@pytest.fixture(scope="module")
def scored(documents):
    rows = corpus()
    return rows, lm.scored(documents(rows, ("row", "h", "rare")).repartition(3), SMALL).collect()


def test_base_equals_brute_force(scored):
    rows, got = scored
    counts = Counter(t for i, text in rows if not is_held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for doc_id, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        want[doc_id, is_held(doc_id), len(own), sum(counts[t] > 0 for t in own), n, round(base, 6)] += 1
    assert Counter((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got) == want
    assert {g.train_types for g in got} == {v}


def test_score_is_a_better_log_probability(scored):
    _, got = scored
    assert all(g.score < 0 for g in got)
    held = [g for g in got if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def small_bucket(slots=4, seed=3, n=3000):
    rng = np.random.default_rng(seed)
    classes = slots + lm.SHAPES
    mass = rng.integers(1, 50, (classes, slots)).astype(float)
    none = np.empty(0, np.int64)
    seen = lm.Vocabulary(int(mass.sum()), 60, slots, 1, 1, none.view(np.uint64), none, none, none, mass)
    h1, h2 = rng.integers(0, 12, n), rng.integers(0, 9, n)
    outcome = np.where(rng.random(n) < 0.6, (h1 * 7 + h2 * 3) % (classes * slots), rng.integers(0, classes * slots, n))
    keys = (h1.astype(np.uint64) << np.uint64(40)) | (h2.astype(np.uint64) << np.uint64(16)) | outcome.astype(np.uint64)
    return seen, keys, rng.random(n) < 0.8


def test_probabilities_sum_to_one():
    seen, keys, learn = small_bucket()
    every = np.arange(seen.classes * seen.slots).astype(np.uint64)
    for h1, h2 in ((3, 4), (11, 0), (500, 501), (3, 77)):  # of a known history and of new ones
        asked = np.uint64(h1 << 40 | h2 << 16) | every
        got = lm.bucket_scores(np.concatenate([keys, asked]), np.concatenate([learn, np.zeros(len(asked), bool)]), seen, SMALL)
        assert abs((10 ** got[len(keys) :]).sum() - 1) < 1e-4


def by_loops(keys, learn, seen, model):
    """The model's log10 probabilities with dictionaries and one history at a time."""
    rows = [(int(k) >> 40, int(k) >> 16 & 0xFFFFFF, (int(k) & 0xFFFF) // seen.slots, (int(k) & 0xFFFF) % seen.slots) for k in keys]
    train = [r for r, own in zip(rows, learn, strict=True) if own]
    prior = seen.mass.sum(axis=1) / seen.mass.sum()
    within = seen.mass / seen.mass.sum(axis=1, keepdims=True)

    def counted(key, value, size):
        out = {}
        for r in train:
            out.setdefault(key(r), np.zeros(size))[value(r)] += 1
        return out

    one = counted(lambda r: r[0], lambda r: r[2], seen.classes)
    two = counted(lambda r: r[1], lambda r: r[2], seen.classes)
    both = counted(lambda r: r[:2], lambda r: r[2], seen.classes)
    inner = counted(lambda r: (r[0], r[2]), lambda r: r[3], seen.slots)
    inner_both = counted(lambda r: r[:3], lambda r: r[3], seen.slots)

    def step(p, counts, times, a):
        return (counts + a) / (times * p + a)

    def first(h):
        c = one.get(h, np.zeros(seen.classes))
        p = prior * step(prior, c, c.sum(), model.before)
        return p / p.sum()

    expected = {h: sum(both.get((x, h), np.zeros(1)).sum() * first(x) for x in one) for h in two}
    out = []
    for h1, h2, k, s in rows:
        p = first(h1)
        if h2 in two and two[h2].sum() >= model.skip_tokens:
            p = p * (two[h2] + model.skip) / (expected[h2] + model.skip)
            p = p / p.sum()
        c = both.get((h1, h2), np.zeros(seen.classes))
        p = p * step(p, c, c.sum(), model.pair)
        q = within[k]
        c = inner.get((h1, k), np.zeros(seen.slots))
        q = q * step(q, c, c.sum(), model.before)
        q = q / q.sum()
        c = inner_both.get((h1, h2, k), np.zeros(seen.slots))
        q = q * step(q, c, c.sum(), model.pair)
        out.append(math.log10(p[k] / p.sum()) + math.log10(q[s] / q.sum()))
    return np.array(out)


def test_bucket_equals_loops():
    for batch in (7, 8192):
        seen, keys, learn = small_bucket(n=600)
        model = lm.Model(batch=batch)
        assert np.abs(lm.bucket_scores(keys, learn, seen, model) - by_loops(keys, learn, seen, model)).max() < 1e-4


def test_partitions_make_no_difference(documents):
    found = []
    for n in (1, 4, 16):
        got = lm.scored(documents(corpus()).repartition(n), SMALL).collect()
        found.append(sorted((g.doc_id or -1, g.held_out, g.n_tokens, g.score) for g in got))
    for other in found[1:]:
        assert [x[:3] for x in other] == [x[:3] for x in found[0]]
        assert max(abs(x[3] - y[3]) for x, y in zip(other, found[0], strict=True)) < 1e-3


def test_documents_that_occur_twice_score_apart(documents):
    once = [(i, invented(i, 60, 3000)) for i in range(1000, 1200)]
    twice = [(i + 1000 * k, invented(i, 60, 3000)) for i in range(2000, 2040) for k in (0, 5)]
    got = {g.doc_id: g.score for g in lm.scored(documents(once + twice)).collect() if not g.held_out}
    top = sorted(v for i, v in got.items() if i < 2000)[-15]
    again = [v for i, v in got.items() if i >= 2000]
    assert sum(v > top for v in again) > 0.6 * len(again)


def test_heavy_histories_are_dealt_on():
    seen = lm.Vocabulary(1000, 50, 4, 1, 8, np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.array([900, 800]), np.ones((20, 4)))
    model = lm.Model(bucket_tokens=100)
    n = 4000
    rng = np.random.default_rng(1)
    doc = rng.integers(0, 1 << 60, n).astype(np.uint64)
    alone = seen.dealt(np.zeros(n, np.int64), rng.integers(2, 500, n), doc, 10, model)
    pair = seen.dealt(np.zeros(n, np.int64), np.ones(n, np.int64), doc, 10, model)
    rare = seen.dealt(np.full(n, 77), rng.integers(2, 500, n), doc, 10, model)
    start = seen.dealt(np.full(n, lm.START), np.full(n, lm.START), doc, 10**6, model)
    assert len(set(rare)) == 1 and all(np.bincount(x, minlength=8).max() < n / 3 for x in (alone, pair, start))


def test_very_long_text(documents):
    got = lm.scored(documents([(1, "word other " * 300_000), (4, "word")])).collect()
    assert {g.doc_id: g.n_tokens for g in got} == {1: 600_001, 4: 2} and all(g.score <= 0 for g in got)


def test_without_training_documents(documents):
    ids = [i for i in range(60) if is_held(i)][:3]
    got = lm.scored(documents([(i, "some words") for i in ids]), SMALL).collect()
    assert len(got) == 3 and all(g.n_known == 0 and g.train_tokens == 0 and g.base_score == g.score == 0 for g in got)
    assert lm.scored(documents([]), SMALL).collect() == []
