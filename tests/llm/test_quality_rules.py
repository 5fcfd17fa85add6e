import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from tessaprobe.llm import quality_rules as q
from tests.llm.conftest import invented

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text.encode())
    found = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if found[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x.encode())]
    return (
        len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered),
    )


ODD = [
    None, "", "   \n\t\x0b", "one", "a b c d e a b c d e", "a\na\n\na \nA", "é ü #$% | <x> & é", "x\x1cy\x85z\xa0w q",
    "the same line of many words\nother\nthe same line of many words\n the  same line of many words",
    "w " * 30000, "ab " * 5 + "\n" + "ab " * 5,
]


def test_counts_equal_brute_force(documents):
    rows = [(i, t) for i, t in enumerate(ODD + [invented(i, 5 + 13 * i, 9 + i) for i in range(30)])]
    rows += [(3, "one"), (None, "null id text of a few words"), (99, "x", None)]
    got = q.judged(documents(rows, ("n_words", "kept", "host"))).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], *brute(r[1])) for r in rows)
    assert Counter((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got) == want
    for g in got:
        assert g.base_failed == (g.n_words < 10 or 100 * g.n_repeat_words > 20 * g.n_words)
        assert not (g.base_failed and g.kept)


def near_copy(i):
    """Five lines of 40 words; in one of them two words are other ones."""
    lines = [invented(7 + k, 40, 9999).split(" ") for k in range(5)]
    for at in (i % 37, (i * 7 + 3) % 40):
        lines[i % 5][at] = f"other{i}"
    return "\n".join(" ".join(line) for line in lines)


def test_frequent_lines_and_depletion(documents):
    passage = "this passage stands in very many unrelated documents of one host"
    rows = [(i, f"{invented(i, 40, 9999)}\n{passage}", "a") for i in range(40)]
    rows += [(100 + i, near_copy(i), "b") for i in range(40)]
    rows += [(200, f"{passage}\n{passage} \n{passage}\nand a short own rest", "a"), (201, passage + "\n" + invented(5, 30), "c")]
    got = {r.doc_id: r for r in q.judged(documents(rows)).collect()}
    assert all(got[i].removed_words == 11 and got[i].kept for i in range(40))
    assert all(got[100 + i].removed_words == 0 and got[100 + i].kept for i in range(40)), "near copies count once"
    assert got[200].removed_words == 33 and not got[200].kept
    assert got[201].removed_words == 0 and got[201].kept, "limits hold per host"
    out = {r.doc_id: r for r in q.cleaned(documents(rows, ("text_key",))).collect()}
    assert 200 not in out and out[3].text == invented(3, 40, 9999) and out[3].n_chars == len(out[3].text)
    assert out[103].text == rows[43][1] and out[201].text == rows[-1][1]


def test_lines_that_come_together_are_counted(documents):
    frame = [invented(900 + k, 8, 9999) for k in range(20)]
    rows = [(i, "\n".join(frame[:10] + [invented(1000 + 3 * i + k, 8, 9999) for k in range(3)] + frame[10:]), "three") for i in range(100)]
    rows += [(1000 + i, "\n".join([*frame, invented(5000 + i, 40, 9999)]), "one") for i in range(500)]
    rows += [(2000 + i, f"read more\n{invented(9000 + i, 30, 9999)}", "short") for i in range(150)]
    rows += [(3000 + i, f"read on\n{invented(9500 + i, 30, 9999)}", "few") for i in range(60)]
    got = {r.doc_id: r for r in q.judged(documents(rows)).collect()}
    assert all(got[i].removed_words == 160 and not got[i].kept for i in range(100)), "frame is 160 of 184 words"
    assert all(got[1000 + i].removed_words == 160 and got[1000 + i].kept for i in range(500))
    assert all(got[2000 + i].removed_words == 2 for i in range(150)) and all(got[3000 + i].removed_words == 0 for i in range(60))


@pytest.mark.parametrize("own", [5, 12, 30, 60])
def test_short_own_lines_dont_spare_a_template(own, documents):
    frame = [invented(900 + k, 10, 9999) for k in range(30)]
    rows = [(i, "\n".join([*frame[:20], invented(2000 + i, own, 99999), *frame[20:]]), "h") for i in range(200)]
    rows += [(500 + i, invented(7000 + i, 50, 9999), "h") for i in range(100)]
    got = {r.doc_id: r for r in q.judged(documents(rows)).collect()}
    assert all(got[i].removed_words == 300 and not got[i].kept for i in range(200))
    assert all(got[500 + i].removed_words == 0 and got[500 + i].kept for i in range(100))


def test_a_page_of_shared_lines_alone_counts_by_its_text(documents):
    frame = [invented(900 + k, 10, 9999) for k in range(12)]
    rng = random.Random(4)
    pages = ["\n".join(rng.sample(frame, 9)) for _ in range(200)]
    got = q.judged(documents([(i, p, "h") for i, p in enumerate(pages)])).collect()
    assert len({frozenset(p.split("\n")) for p in pages}) > 60
    assert all(r.removed_words == 90 and not r.kept for r in got)


def test_copies_count_once(documents):
    frame = [invented(900 + k, 8, 9999) for k in range(6)]
    rows = [(i, "\n".join([*frame, invented(20, 50, 9999)]), "exact") for i in range(50)]
    rows += [(100 + i, "\n".join([invented(40 + i % 30, 300, 9999), frame[0], f"copy {i}"]), "clusters") for i in range(900)]
    got = {r.doc_id: r for r in q.judged(documents(rows)).collect()}
    assert all(got[i].removed_words == 0 for i in range(50))
    assert all(got[100 + i].removed_words == 8 and got[100 + i].kept for i in range(900)), "30 near-copied texts carry the line"


@pytest.mark.parametrize("seed", [1, 2])
def test_all_equals_sql(seed, documents):
    rng = random.Random(seed)
    frame = [invented(900 + k, rng.randrange(1, 12), 9999) for k in range(12)]
    rows = [(i, "\n".join([*rng.sample(frame, rng.randrange(6)), *(invented(100 * i + k, rng.randrange(1, 30), 9999) for k in range(rng.randrange(4)))]), "h") for i in range(400)]
    base = [invented(50 + k, 12, 9999) for k in range(8)]
    rows += [(500 + i, "\n".join(x for x in [*base, frame[0].upper() + "  "] if rng.random() < 0.95), rng.choice([None, "h", "k"])) for i in range(150)]
    rows += [(700 + i, t) for i, t in enumerate(ODD)] + rows[:60] + [(None, frame[1], None)] * 30
    df = documents(rows)
    got = q.judged(df).collect()
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "source": [r[2] if len(r) > 2 else "s" for r in rows]})
    con = duckdb.connect()
    con.register("documents", table)
    found = con.execute(q.op6_sql())
    names = [d[0] for d in found.description]
    assert Counter(tuple(r[c] for c in names) for r in got) == Counter(found.fetchall())
    assert sum(r.removed_words > 0 for r in got) > 100 and 0 < sum(r.kept for r in got) < len(got)


def test_empty_table(documents):
    assert q.judged(documents([])).collect() == [] and q.cleaned(documents([])).collect() == []


@pytest.mark.parametrize("text", ODD)
def test_cutting_leaves_other_lines(text, documents):
    kept = q.cleaned(documents([(1, text)])).collect()
    assert all(r.text == text for r in kept)
