"""SimHash near-dedup against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessaprobe.llm.simhash_dedup import Sim, fingerprint, gray_rank, grouped, links_of_nodes, op13_simhash_near_dedup
from tests.llm.conftest import invented

SF = "/root/testdata/sf0.001"


def plain_print(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(rows):
    """(doc_id, text) -> sorted (doc_id, fingerprint, component)."""
    prints = [plain_print(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                label[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((d, f"{p:016x}", least[top(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "fingerprint", "component_id")) for r in df.collect()), key=str)


def near_copies(seed, n):
    rng = random.Random(seed)
    rows = []
    for g in range(n):
        words = invented(seed * 100 + g, 300).split()
        for _ in range(rng.randrange(1, 6)):
            mine = list(words)
            for _ in range(rng.randrange(0, 3)):
                mine[rng.randrange(len(mine))] = "other"
            rows.append((len(rows) * 3 + 1, " ".join(mine)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one  TWO", "a b c", "Ä b C d e\x0bf\x0cg", "x y z " * 500, "É à b"])
def test_fingerprint(text):
    assert fingerprint(text.encode() if text is not None else None, 3, 42) == plain_print(text)


def test_fingerprint_in_pieces(monkeypatch):
    text = invented(5, 1000)
    monkeypatch.setattr("tessaprobe.llm.simhash_dedup.PIECE", 64)
    assert fingerprint(text.encode(), 3, 42) == plain_print(text)


def test_gray_rank():
    codes = np.array([i ^ (i >> 1) for i in range(1000)], np.uint64)
    assert gray_rank(codes).tolist() == list(range(1000))


@pytest.mark.parametrize("sim", [Sim(), Sim(most=3), Sim(most=40, leaf=4, fan=2), Sim(most=2, tail=40)])
def test_against_all_pairs(spark, documents, sim):
    rows = near_copies(3, 40)
    assert got(grouped(documents(rows), sim)) == brute(rows)


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_all_links_of_a_node(seed):
    """Random members, dense balls and chains: the forest connects what all pairs connect."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 5).astype(np.uint64)
    prints = np.concatenate([centres] + [c ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) for c in centres])
    prints = np.unique(prints)
    pairs = links_of_nodes(np.zeros(len(prints), np.int64), np.zeros(len(prints), np.int64), prints, Sim(leaf=8, fan=3))
    assert (np.bitwise_count(prints[pairs[:, 0]] ^ prints[pairs[:, 1]]) <= 3).all()

    def labelled(edges):
        name = list(range(len(prints)))

        def top(x):
            while name[x] != x:
                x = name[x]
            return x

        for a, b in edges:
            a, b = sorted((top(a), top(b)))
            name[b] = a
        return [top(i) for i in range(len(prints))]

    every = np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3).tolist()
    assert labelled(pairs.tolist()) == labelled(every)
    assert len(pairs) == len(prints) - len(set(labelled(every)))


def test_copies_nulls_repeats_and_words(spark, documents):
    long = invented(1, 30000)
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "a b"), (4, "a b"), (5, "A  B"), (None, long), (9, long + " end"), (8, long), (None, "only null ids"), (7, "one")]
    rows += [(100 + i, "very many copies of this one text stand here") for i in range(300)]
    assert got(grouped(documents(rows))) == brute(rows)


def test_linked_by_a_row_without_id(spark, documents):
    """Two texts that only a third, without an id, connects."""
    rows = near_copies(11, 30)
    rows = [(None if i % 3 == 0 else d, t) for i, (d, t) in enumerate(rows)]
    assert got(grouped(documents(rows), Sim(most=5))) == brute(rows)


def test_empty_and_clashing_columns(spark, documents):
    assert grouped(documents([])).collect() == []
    rows = near_copies(7, 5)
    assert got(grouped(documents(rows, extra=("print", "node", "component_id", "fingerprint", "n")))) == brute(rows)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(op13_simhash_near_dedup(spark, SF)) == brute(rows)
