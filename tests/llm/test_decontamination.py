import random

import pytest

from tessaprobe.llm import decontamination as dc
from tests.llm.conftest import invented


def brute_tiles(item, text, least):
    """Greedy string tiling straight from its definition."""
    free_a, free_b, out = [True] * len(item), [True] * len(text), []
    least = min(least, len(item))
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and free_a[i + k] and free_b[j + k] and item[i + k] == text[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < max(1, least):
            return out
        free_a[i : i + k] = [False] * k
        free_b[j : j + k] = [False] * k
        out.append((i, j, k))


@pytest.mark.parametrize("seed", range(40))
def test_tiles_equal_brute_force(seed):
    rng = random.Random(seed)
    item, text = [rng.randrange(6) for _ in range(rng.randrange(0, 14))], [rng.randrange(6) for _ in range(rng.randrange(0, 30))]
    got, want = dc.tiles(item, text, 3), brute_tiles(item, text, 3)
    assert sorted(k for *_, k in got) == sorted(k for *_, k in want)
    for i, j, k in got:
        assert item[i : i + k] == text[j : j + k]


def planted(documents, spark):
    items = [(i, invented(500 + i, 30, 10**6)) for i in range(20)] + [(90, "Tiny item"), (91, ""), (92, None), (93, "...")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    w = {i: t.split() for i, t in items if t}
    clean = [(1000 + i, invented(i, 120, 300)) for i in range(30)]
    hit = [
        (1, invented(1, 50) + " " + items[3][1] + " " + invented(2, 50)),
        (2, items[4][1].upper().replace(" ", ", ")),
        (3, " ".join(w[5][15:] + ["gap", "gap"] + w[5][:15])),
        (4, " ".join(w[6][20:30] + ["x"] + w[6][0:10] + ["y"] + w[6][10:20])),
        (5, items[7][1] + "\n" + items[8][1]),
        (6, "some tiny ITEM here"),
        (7, " ".join(w[9][:26])),
    ]
    miss = [(8, " ".join(w[10][:20])), (9, " ".join(x for p in zip(w[11], w[12]) for x in p)), (10, None), (11, "")]
    return documents(clean + hit + miss, ("item_id",)), benchmark


def test_planted_passages(documents, spark):
    docs, benchmark = planted(documents, spark)
    want = {(1, 3), (2, 4), (3, 5), (4, 6), (5, 7), (5, 8), (6, 90), (7, 9)}
    got = dc.contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {r.tiles for r in got if r.doc_id == 4} == {3} and {r.coverage for r in got if r.doc_id == 4} == {1.0}
    coarse = dc.contaminated(docs.repartition(3), benchmark.repartition(5), dc.Tiling(sieve_bits=15, salts=3)).collect()
    assert {(r.doc_id, r.item_id) for r in coarse} == want, "a full sieve, other splits"
    stay = dc.clean(docs, benchmark)
    assert stay.columns == docs.columns
    assert {r.doc_id for r in stay.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_empty_tables(documents, spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert dc.contaminated(documents([(1, "a b c d e f")]), none).collect() == []
    assert dc.contaminated(documents([]), spark.createDataFrame([(1, "a b c d e")], "item_id bigint, text string")).collect() == []


def words_of(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()


def pairs_by_loops(docs, items, tiling):
    """Every text against every item, by the plain definition of tiling."""
    out = []
    for doc_id, text in docs:
        for item_id, own in items:
            item, words = words_of(own), words_of(text)
            if item and set(item) & set(words):
                found = brute_tiles(item, words, tiling.least_tile)
                covered = sum(k for *_, k in found)
                if found and 100 * covered >= tiling.percent * len(item):
                    out.append((doc_id, item_id, covered, len(item)))
    return sorted(out, key=str)


def test_equals_brute_force_over_all_pairs(documents, spark):
    rng = random.Random(5)
    items = [(i, invented(700 + i, rng.randrange(1, 40), 60)) for i in range(25)] + [(3, "same id again"), (None, "no id here at all"), (40, None), (41, " ?! ")]
    docs = [(i, invented(i, rng.randrange(0, 80), 60)) for i in range(40)]
    for n, run in enumerate((3, 4, 6, 5, 2)):  # items cut into runs that are dealt anew; every so many tokens are changed
        for item_id, text in items[:12]:
            own = text.split()
            cut = [own[i : i + run] for i in range(0, len(own), run)]
            rng.shuffle(cut)
            docs.append((100 * n + 1000 + (item_id or 0), " ".join(["start"] + [w for part in cut for w in [*part, "gap"]])))
            docs.append((100 * n + 2000 + (item_id or 0), " ".join("changed" if i % run == run - 1 else w for i, w in enumerate(own))))
    docs += [(None, items[5][1]), (None, items[5][1]), (5007, items[6][1]), (5007, items[6][1]), (5008, None), (5009, "")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    for tiling in (dc.Tiling(), dc.Tiling(least_tile=4, percent=60)):
        got = dc.contaminated(documents(docs, ("item_id",)).repartition(4), table, tiling).collect()
        assert sorted(((r.doc_id, r.item_id, r.tiled_tokens, r.item_tokens) for r in got), key=str) == pairs_by_loops(docs, items, tiling)
    gone = {d for d, *_ in pairs_by_loops(docs, items, dc.Tiling())}
    left = dc.clean(documents(docs, ("item_id", "key", "row")), table).collect()
    assert sorted(str(r.doc_id) for r in left) == sorted(str(d) for d, _ in docs if d not in gone)


def test_very_long_text(documents, spark):
    items = spark.createDataFrame([(1, invented(9, 60, 10**6)), (2, invented(10, 60, 10**6))], "item_id bigint, text string")
    long = invented(1, 500_000) + " " + " ".join(invented(9, 60, 10**6).split()[30:] + ["x"]) + " " + invented(2, 500_000) + " " + " ".join(invented(9, 60, 10**6).split()[:30])
    got = dc.contaminated(documents([(5, long)]), items).collect()
    assert [(r.doc_id, r.item_id, r.coverage) for r in got] == [(5, 1, 1.0)]
