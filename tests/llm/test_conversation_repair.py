"""Conversation repair against plain search over all edits, and against its SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

from tessaprobe.llm import conversation_repair as repair

COLUMNS = ["conv_id", *repair.FIELDS]
WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def least(codes):
    """Cheapest (cost, audit) by a table over rows and states, with the least string kept."""
    best = {"": (0, "")}  # roles so far, up to what matters: "" nothing, s, u, a

    def inserts(b):
        for _ in range(3):
            for s, (c, t) in list(b.items()):
                to = "a" if s == "u" else "u"
                b[to] = min(b.get(to, (10**9, "")), (c + 2, t + "I"))
        return b

    best = inserts(best)
    for code in codes:
        initial, fault = "sua?"[code // 4], code % 4
        new = {}
        for s, (c, t) in best.items():
            ways = [(s, c + 3, t + "D")]
            if fault < 2:
                to = "a" if s == "u" else "u"
                ways.append((to, c + 2 + fault, t + "R"))
                if initial == to or (initial, s) == ("s", ""):
                    ways.append((initial, c + fault, t + "K"))
            for to, cost, text in ways:
                new[to] = min(new.get(to, (10**9, "")), (cost, text))
        best = inserts(new)
    return min(best.get("", (10**9, "")), best["a"])


def searched(codes, most=3):
    """Cheapest (cost, audit) among all strings of edits with at most ``most`` inserts."""
    found = []
    for extra in range(most + 1):
        for places in itertools.combinations_with_replacement(range(len(codes) + 1), extra):
            for letters in itertools.product("DKR", repeat=len(codes)):
                if any(c % 4 > 1 and x != "D" for c, x in zip(codes, letters, strict=True)):
                    continue
                audit, items = "", []
                for i in range(len(codes) + 1):
                    audit += "I" * places.count(i)
                    items += ["ua"] * places.count(i)
                    if i < len(codes):
                        audit += letters[i]
                        items += {"D": [], "R": ["ua"], "K": ["sua?"[codes[i] // 4]]}[letters[i]]
                if any(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in itertools.product(*items)):
                    cost = sum({"D": 3, "I": 2, "R": 2, "K": 0}[x] for x in audit) + sum(c % 4 == 1 and x != "D" for c, x in zip(codes, letters, strict=True))
                    found.append((cost, audit))
    return min(found)


def brute(rows):
    convs = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [((turn is not None, turn or 0), "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort()
        codes, seen = [], set()
        for _, role, text in own:
            fault = 2 if not text.strip(WHITE) else 3 if (role, text) in seen else 1 if text.rstrip(WHITE)[-1] not in ".!?" else 0
            seen.add((role, text))
            codes.append(("sua".index(role[0]) if role and role[0] in "sua" else 3) * 4 + fault)
        cost, audit = least(codes)
        items, state, at = [], "", iter(own)
        for x in audit:
            to = "a" if state == "u" else "u"
            if x == "I":
                items.append({"u": "user:", "a": "assistant:"}[to])
                state = to
                continue
            _, role, text = next(at)
            if x != "D":
                state = to if x == "R" else role[0]
                items.append(f"{ {'u': 'user', 'a': 'assistant'}[to] if x == 'R' else role}:{text}")
        turns = [t for (known, t), *_ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [sum(c % 4 == f for c in codes) for f in (2, 3, 1)]
        illegal = sum("sua?"[a // 4] + "sua?"[b // 4] not in ("su", "ua", "au") for a, b in itertools.pairwise(codes))
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(items).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64", "role": "string", "text": "string"})
        con.register("frame", frame)
        con.execute("INSERT INTO conversations SELECT * FROM frame")
    found = con.execute(repair.op11_sql())
    names = [d[0] for d in found.description]
    return sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in found.fetchall()), key=str)


def invented(seed, n, longest=9):
    rng = random.Random(seed)
    texts = ["Hello.", "Yes!", "no end", "cut off ", "Why? \n", " \t", "", None, "Ünd.", "fine."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.7 else rng.choice(roles)
            text = f"text {rng.randrange(99)}." if rng.random() < 0.5 else rng.choice(texts)
            rows.append((conv if rng.random() < 0.98 else None, turn + rng.randrange(2) * 5 if rng.random() < 0.95 else None, role, text))
    rng.shuffle(rows)
    return rows


def test_tables_against_search():
    for n in range(4):
        for codes in itertools.product([0, 1, 4, 5, 8, 9, 12, 2, 7], repeat=n):
            assert repair.cheapest(bytes(codes)) == least(codes)
    rng = random.Random(1)
    for _ in range(150):
        codes = [rng.choice([0, 1, 4, 5, 8, 9, 12, 13, 3]) for _ in range(rng.randrange(5))]
        assert repair.cheapest(bytes(codes)) == searched(codes)


@pytest.mark.parametrize("seed", range(20))
def test_long_conversations(seed):
    rng = random.Random(seed)
    codes = [rng.randrange(16) for _ in range(rng.randrange(400))]
    assert repair.cheapest(bytes(codes)) == least(codes)


def test_vectors_are_few():
    assert len(repair.tables()[0]) < 40


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force_and_sql(spark, seed):
    rows = invented(seed, 150)
    want = brute(rows)
    assert got(repair.repaired(repair.damaged(spark.createDataFrame(rows, SCHEMA)))) == want
    assert by_sql(rows) == want


def test_one_conversation_of_many_rows(spark, monkeypatch):
    """Most rows are one conversation's, many with the same text: it crosses tasks and chunks."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["same.", f"own {t}.", f"cut {t}", ""])) for t in range(2500)]
    rows += [(7, None, "user", f"no turn {i % 3}.") for i in range(200)] + invented(8, 40)
    rng.shuffle(rows)
    assert got(repair.repaired(repair.damaged(spark.createDataFrame(rows, SCHEMA).repartition(6)))) == brute(rows)


def test_long_text_repeats_and_only_dropped_rows(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "gone."), (5000, 1, "user", "x" * 400_000 + "."), (5000, 2, "assistant", "y " * 300_000), (6000, 3, "user", "a."), (6000, 3, "user", "a."), (6000, 3, "user", "a.")]
    found = got(repair.repaired(repair.damaged(spark.createDataFrame(rows, SCHEMA))))
    assert found == brute(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in found


def test_empty_and_clashing_columns(spark):
    assert repair.repaired(repair.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    assert by_sql([]) == []
    rows = invented(4, 20)
    wide = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", place int, fault int, n int")
    assert got(repair.repaired(repair.damaged(wide))) == brute(rows)
