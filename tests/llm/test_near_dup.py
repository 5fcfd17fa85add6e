import itertools
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tessaprobe.llm import near_dup as nd
from tests.llm.conftest import invented

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_set(text):
    words = [w.lower() for w in WORD.findall((text or "").encode())]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), least[find(i)], doc_id == least[find(i)]) for i, (doc_id, _) in enumerate(rows))


def edited(text, rng, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=3):
    rng = random.Random(seed)
    rows = [(1000 + i, invented(i, rng.randrange(1, 200))) for i in range(60)]
    base = invented(77, 180, 10**6)
    rows += [(i, edited(base, rng, rng.randrange(0, 9))) for i in range(120)]
    rows += [(3000 + i, base) for i in range(50)]
    passage = invented(5, 60, 10**6)
    rows += [(4000 + i, passage + " " + invented(900 + i, 70, 10**6)) for i in range(80)]
    for k in range(40):  # small groups, the smallest id being the original or a copy
        text = invented(7000 + k, rng.randrange(20, 300), 10**6)
        rows += [(6000 + 10 * k + rng.randrange(0, 9), text)] + [(6000 + 10 * k + 9, edited(text, rng, rng.randrange(0, 5)))]
    rows += [(5000, ""), (5001, " \n"), (5002, "A b"), (5003, "a B"), (5004, "b"), (5005, "é x y"), (5006, "É x y")]
    return rows


@pytest.mark.parametrize("block,seed,pivots", [(256, 3, 16), (20, 4, 16), (20, 5, 2), (5, 6, 3)])
def test_components_equal_brute_force(documents, block, seed, pivots):
    rows = corpus(seed)
    got = nd.grouped(documents(rows, ("component_id", "id")), nd.Near(block=block, pivots=pivots)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows)


def test_groups_of_one_neighbourhood(documents, monkeypatch):
    """Two groups and a chain that share one band's key: unverified, all are one neighbourhood of many blocks."""
    rng = random.Random(12)
    base = [invented(1, 60, 10**6), invented(2, 60, 10**6)]
    rows = [(i, edited(base[i % 2 or i % 3 > 0], rng, rng.randrange(0, 3))) for i in range(150)]
    walk = invented(4, 60, 10**6)
    for i in range(60):
        rows.append((500 + i, walk))
        walk = edited(walk, rng, 1)
    rows += [(900 + i, invented(50 + i, 60, 10**6)) for i in range(9)] + rows[:4]
    true = nd.band_hashes
    monkeypatch.setattr(nd, "band_hashes", lambda s, b, r: np.concatenate([np.zeros((len(s), 1), np.uint64), true(s, b, r)[:, 1:]], axis=1))
    met = []
    across = nd.store.per_run
    monkeypatch.setattr(nd.store, "per_run", lambda df, keys, fn, schema: met.append(keys) or across(df, keys, fn, schema))
    got = nd.grouped(documents(rows), nd.Near(block=16, pivots=4)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows)
    assert ["place", "part", "own"] in met


def test_components_of_edges(spark):
    from tessaprobe.llm import store

    rng = random.Random(8)
    edges = [(5, 1), (9, 9), (20, 21), (21, 22), (22, 23), (23, 20)] + [(100 + i, 101 + i) for i in range(40)] + [(300, 300 + i) for i in range(1, 30)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = store.components(spark.createDataFrame(edges, "u bigint, v bigint"), "test").collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 600, dtype=np.uint64)
    a, b = np.sort(pool[:400]), np.sort(pool[100:500])
    s = nd.super_minhash(np.concatenate([a, b]), np.array([0, 400, 800]), 250)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.12
    assert (s < np.iinfo(np.uint64).max).all()


def test_nulls_repeats_and_empty(documents, spark):
    rows = [(5, None), (None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "only here x"), (8, None)]
    got = sorted(map(tuple, nd.grouped(documents(rows)).collect()), key=str)
    want = [(5, 0, 5, True), (None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (None, 1, None, True), (8, 0, 8, True)]
    assert got == sorted(want, key=str)
    stay = nd.one_of_each(documents(rows)).collect()
    assert sorted(r.doc_id for r in stay if r.doc_id is not None) == [5, 7, 8]
    assert nd.grouped(documents([])).collect() == []


def test_shares_of_keys_are_dealt_and_nothing_is_lost(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, i) for i in range(300)] + [(k, k) for k in range(1, 50)] + [(99, 1)], "k int, v int")
    one = rows.where("k <> 99").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(one.drop("n"), "k", how).collect()))
        assert sorted(map(str, nd.store.joined_by_share(rows, one, ["k"], 350, F.xxhash64("v"), how, 20).collect())) == want


def test_signatures_in_pieces_are_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = [0, 1, 40, 3000, 7, 0, 500]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    values = rng.integers(0, 1 << 63, starts[-1]).astype(np.uint64)
    whole = nd.super_minhash(values, starts, 224)
    monkeypatch.setattr(nd, "ELEMENTS", 97)
    assert (nd.super_minhash(values, starts, 224) == whole).all()


def test_tied_pivot_groups_lose_no_link():
    """A chain p, x, y, q across two blocks whose pivots p and q are groups of equal size: whatever the order of rows in a block, x and y
    are compared somewhere."""
    sets = {1: range(0, 100), 2: range(8, 108), 3: range(16, 116), 4: range(24, 124)}
    pivots, owns = {1, 4}, {1: 0, 2: 0, 3: 1, 4: 1}

    def block(k, order):
        rows = [i for i in order if i in pivots or owns[i] == k]
        raw = [np.array(sets[i], np.uint64).tobytes() for i in rows]
        columns = {"place": [9] * len(rows), "blocks": pa.array([2] * len(rows), pa.int32()), "dealt": pa.array([k] * len(rows), pa.int32()), "own": pa.array([owns[i] for i in rows], pa.int32())}
        return pa.table(columns | {"id": rows, "pivot": [i in pivots for i in rows], "shingles": pa.array(raw, pa.binary())})

    for one in itertools.permutations(sets):
        for two in itertools.permutations(sets):
            found = [r for k, order in enumerate((one, two)) for batch in nd.links_of_block(block(k, order), 85) for r in batch.to_pylist()]
            unsettled = {r["u"] for r in found if r["v"] is None}
            assert unsettled & {2, 3}  # one of them meets the other's block
            assert {frozenset((r["u"], r["v"])) for r in found if r["v"] is not None} == {frozenset((1, 2)), frozenset((3, 4))}
