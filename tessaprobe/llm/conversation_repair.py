"""Operator 11, conversation structure repair: cheapest edits by Four-Russians block tables.

A conversation's rows, in order, have faults (``blank``: no character but white space; ``duplicate``: role and text seen earlier in it; ``truncated``:
does not end in one of ``.!?``; the first that fits counts). Edits make the roles' initials match ``(s?(ua)+)?``: Keep costs 0, Rerole (to user or assistant)
2, Delete 3, Insert (an empty text of user or assistant, anywhere) 2. Blank and duplicate rows must go; a truncated row that stays adds 1. Among
the cheapest edits the one whose initials (``audit``) come first in ASCII counts.

Where the roles stand (nothing yet, after s, after u, after a) is one of four states. What the rest of a conversation costs from each state is a
vector; less its least entry, only a few dozen vectors can occur. Tables give, for each vector and each block of ``BLOCK`` symbols (initial and fault of a
row), the vector before the block and what it costs. A conversation is walked block by block from its end by lookups; then, from
its start, each block is expanded backward from the vector at its right end, which gives the vector at every row, and the least
letter that keeps the cost is taken, so ties are decided by what is still to come.

Plan: faults are column expressions (the first of equal texts by an aggregate, joined only where texts recur, common ones dealt by their share).
Rows are sorted over all tasks by conversation and turn. A conversation that lies within one task is repaired there; one that crosses a border, or has more
than ``CHUNK`` rows, is handed on in chunks. Its symbols, a byte for each row like the audit itself, meet in one task; texts only stream
past the audit for the hash. So a conversation of a third of all rows is sorted, damaged and cut by many tasks.

Defined cases: a null role, text, or part of the damage key is one space; rows of a null conv_id are a conversation; rows
of equal turn (null turns come first) are ordered by role and text as damaged; of equal rows any may be the first; a role that is empty or begins with another
letter than s, u, a can't be kept; texts of any length; gaps that exceed a long are the largest long; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaprobe.llm import store

BLOCK = 3
CHUNK = 512  # rows of a conversation that a task holds, and
CHUNK_CHARS = 1 << 17  # their text, before it hands them on
WHITE = " \t\n\x0b\x0c\r"
START, S, U, A = range(4)
FOLLOWS = (U, U, A, U)  # where a rerole or an insert leads, by state
NAMES = ("", "", "user", "assistant")
MUST_GO, NO_ROW = 8, 9  # symbols besides initial * 2 + truncated; NO_ROW fills a last block
SYMBOLS = 10
OK, TRUNCATED, BLANK, DUPLICATE = range(4)  # faults; a row's code is initial * 4 + fault
NEVER = 1 << 30


def kept_state(state: int, initial: int) -> int | None:
    """Where keeping a row leads; initials: 0 s, 1 u, 2 a, 3 others."""
    if state == START and initial == 0:
        return S
    return FOLLOWS[state] if initial + 1 == FOLLOWS[state] and initial in (1, 2) else None


def with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in range(4):
        costs = [min(c, 2 + costs[FOLLOWS[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


def before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """What the rest costs from each state before a row, from what it costs after it."""
    if symbol == NO_ROW:
        return after
    costs = [3 + c for c in after]
    if symbol != MUST_GO:
        initial, extra = divmod(symbol, 2)
        for s in range(4):
            kept = kept_state(s, initial)
            costs[s] = min(costs[s], 2 + extra + after[FOLLOWS[s]], NEVER if kept is None else extra + after[kept])
    return with_inserts(costs)


END = with_inserts([0, NEVER, NEVER, 0])


@cache
def tables() -> tuple:
    """Normalised vectors; per vector and symbol the vector before it, its offset, and for each state the letters and the state they lead to;
    per vector and block the vector before the block and the sum of the offsets."""
    vectors, number, steps = [END], {END: 0}, []
    for vector in vectors:  # grows as it is read
        row = []
        for symbol in range(SYMBOLS):
            costs = before(vector, symbol)
            least = min(costs)
            shape = tuple(c - least for c in costs)
            if shape not in number:
                number[shape] = len(vectors)
                vectors.append(shape)
            row.append((number[shape], least))
        steps.append(row)
    letters = [[[taken(vector, symbol, s) for s in range(4)] for symbol in range(SYMBOLS)] for vector in vectors]
    one, cost = (np.array([[x[k] for x in row] for row in steps]) for k in (0, 1))
    to, total = np.arange(len(vectors))[:, None], np.zeros((len(vectors), 1), np.int64)
    for _ in range(BLOCK):  # a block's code has its first row as the highest digit; the last row is applied first
        to, total = np.concatenate([one[to, s] for s in range(SYMBOLS)], axis=1), np.concatenate([total + cost[to, s] for s in range(SYMBOLS)], axis=1)
    return vectors, one.tolist(), letters, to.tolist(), total.tolist()


def taken(after: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
    """The least letters, up to the one that uses the row up, by which the cheapest edits go on, and the state after them."""
    costs, out = before(after, symbol), ""
    while symbol != NO_ROW:
        cost = costs[state]
        if cost == 3 + after[state]:
            return out + "D", state
        if cost == 2 + costs[FOLLOWS[state]]:
            out, state = out + "I", FOLLOWS[state]
            continue
        initial, extra = divmod(symbol, 2)
        kept = kept_state(state, initial)
        if kept is not None and cost == extra + after[kept]:
            return out + "K", kept
        return out + "R", FOLLOWS[state]
    return out, state


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and audit of one conversation, from its rows' codes."""
    vectors, one, letters, block_to, block_cost = tables()
    symbols = bytes(MUST_GO if c % 4 >= BLANK else c // 4 * 2 + (c % 4 == TRUNCATED) for c in codes)
    symbols += bytes([NO_ROW]) * (-len(symbols) % BLOCK)
    places = range(0, len(symbols), BLOCK)
    blocks = [symbols[p] * SYMBOLS * SYMBOLS + symbols[p + 1] * SYMBOLS + symbols[p + 2] for p in places]
    right, at, cost = bytearray(len(blocks)), 0, 0  # at: the vector at a block's right end
    for k in range(len(blocks) - 1, -1, -1):
        right[k] = at
        cost += block_cost[at][blocks[k]]
        at = block_to[at][blocks[k]]
    cost += vectors[at][START]
    state, audit = START, []
    for k, p in enumerate(places):
        after = [right[k]]
        for i in (p + 2, p + 1):
            after.append(one[after[-1]][symbols[i]])
        for i in range(BLOCK):
            out, state = letters[after[BLOCK - 1 - i]][symbols[p + i]][state]
            audit.append(out)
    while END[state]:  # rows are used up
        audit.append("I")
        state = FOLLOWS[state]
    return int(cost), "".join(audit)


class Repaired:
    """SHA-256 of the repaired rows, fed with rows in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.hash, self.first = audit, 0, START, hashlib.sha256(), True

    def put(self, role: str, text: str) -> None:
        self.hash.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False

    def insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = FOLLOWS[self.state]
            self.put(NAMES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insert()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            self.state = FOLLOWS[self.state]
            self.put(NAMES[self.state], text)
        elif letter == "K":
            self.state = kept_state(self.state, initial_of(role))
            self.put(role, text)

    def hexdigest(self) -> str:
        self.insert()
        return self.hash.hexdigest()


def initial_of(role: str) -> int:
    return {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)


LEGAL = {(0, 1), (1, 2), (2, 1)}


def figures(codes: bytes, least: int | None, most: int | None, turns: int) -> dict:
    """All columns but the hash, of one conversation."""
    cost, audit = cheapest(codes)
    faults = [codes.translate(None, bytes(c for c in range(16) if c % 4 != f)) for f in (BLANK, DUPLICATE, TRUNCATED)]
    illegal = sum((a // 4, b // 4) not in LEGAL for a, b in zip(codes, codes[1:], strict=False))
    gaps = 0 if least is None else min(most - least + 1 - turns, (1 << 63) - 1)
    return {"gaps": gaps, "blank": len(faults[0]), "duplicate": len(faults[1]), "truncated": len(faults[2]), "illegal": illegal, "cost": cost, "audit": audit}


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
FIELDS = [x.split()[0] for x in RESULT.split(", ")]
OPEN = "part int, chunk int, codes binary, first_turn bigint, last_turn bigint, turns bigint, roles array<string>, texts array<string>"
OPEN_FIELDS = [x.split()[0] for x in OPEN.split(", ")]


class Rows:
    """Rows of one conversation that a task holds."""

    def __init__(self) -> None:
        self.codes, self.roles, self.texts, self.chars = bytearray(), [], [], 0
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: int) -> None:
        if copies and turn is not None:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        for copy in range(copies):
            own = fault if not copy or fault == BLANK else DUPLICATE
            self.codes.append(initial_of(role) * 4 + own)
            self.roles.append(role)
            self.texts.append("" if own >= BLANK else text)  # goes anyway
            self.chars += len(self.texts[-1])


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: damage by crc32 of ``conv_id:turn``; a dropped row stays with no copies, so its conversation is known."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    text = or_space("text")
    return rows.select("conv_id", "turn", or_space("role").alias("_role"), text.alias("_text"), kind.alias("_kind")).select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias("role"),
        F.when(F.col("_kind") <= 1, "").when(F.col("_kind") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text")).alias("text"),
        F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1).alias("copies"),
    )


def faulty(rows: DataFrame) -> DataFrame:
    """With ``place``, unique, and ``fault`` of each row's first copy."""
    end = F.rtrim("text", F.lit(WHITE))
    fault = F.when(end == "", BLANK).when(F.right(end, F.lit(1)).isin(".", "!", "?"), OK).otherwise(TRUNCATED)
    rows = store.written(rows.withColumns({"place": F.monotonically_increasing_id(), "fault": fault, "one": F.xxhash64("conv_id", "role", "text"), "two": F.xxhash64(F.lit(1), "text", "role", "conv_id")}), "repair-rows")
    seen = rows.where((F.col("fault") != BLANK) & (F.col("copies") > 0))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "place")
    first = seen.groupBy("one", "two").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
    first = store.written(first.select("one", "two", "n", F.col("first.place").alias("first")), "repair-recurring")
    marked = store.joined_by_share(rows, first, ["one", "two"], rows.count(), F.xxhash64("place"), "left")
    again = (F.col("fault") != BLANK) & (F.col("first") != F.col("place"))
    return marked.select("conv_id", "turn", "role", "text", "copies", "place", F.when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault"))


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id and the columns of RESULT: one row per conversation of rows (conv_id, turn, role, text, copies)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    keys = [F.col("conv_id"), F.col("turn"), F.left("role", F.lit(64)), F.left("text", F.lit(64)), F.col("place")]
    ordered = faulty(rows).repartitionByRange(*keys).sortWithinPartitions("conv_id", "turn", "role", "text", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, out = TaskContext.get().partitionId(), 0, []
        held, now, open_, schema = None, None, True, None  # the first conversation may have begun in another task

        def handed_on() -> dict:
            return {"conv_id": now, "part": part, "chunk": chunk, "codes": bytes(held.codes), "first_turn": held.first_turn, "last_turn": held.last_turn, "turns": held.turns, "roles": held.roles, "texts": held.texts}

        def finished() -> dict:
            found = figures(bytes(held.codes), held.first_turn, held.last_turn, held.turns)
            told = Repaired(found["audit"])
            for role, text in zip(held.roles, held.texts, strict=True):
                told.row(role, text)
            return {"conv_id": now, **found, "repaired_sha256": told.hexdigest()}

        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *FIXED])
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault")]
            for conv, turn, role, text, copies, fault in zip(*columns, strict=True):
                if held is None or conv != now:
                    if held is not None:
                        out.append(handed_on() if open_ else finished())
                        open_, chunk = False, 0
                    held, now = Rows(), conv
                elif len(held.codes) >= CHUNK or held.chars >= CHUNK_CHARS:
                    out.append(handed_on())
                    held, open_, chunk = Rows(), True, chunk + 1
                held.add(turn, role, text, copies, fault)
                if len(out) >= 1000 or (out and held.chars >= CHUNK_CHARS):
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if held is not None:
            yield pa.RecordBatch.from_pylist([*out, handed_on()], schema)  # the last one may go on in another task

    found = store.written(ordered.mapInArrow(run, f"conv_id {kind}, {OPEN}, {RESULT}"), "repair-found")
    crossing = found.where("part is not null").select("conv_id", *OPEN_FIELDS)
    return found.where("part is null").select("conv_id", *FIELDS).unionByName(_crossing(crossing, kind))


FIXED = [("part", pa.int32()), ("chunk", pa.int32()), ("codes", pa.binary()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
FIXED += [(f, pa.int64()) for f in FIELDS[:6]] + [(f, pa.string()) for f in FIELDS[6:]]


def _crossing(chunks: DataFrame, kind: str) -> DataFrame:
    """The same for conversations in chunks: one task adds up the codes and turns, another lets the texts pass."""
    place = ["conv_id", "part", "chunk"]

    def audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, least, last, turns, begun = None, bytearray(), None, None, 0, False
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *FIXED[-8:-1]])
            out = []
            for conv, own, first_turn, last_turn, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "codes", "first_turn", "last_turn", "turns")), strict=True):
                if begun and conv != now:
                    out.append({"conv_id": now, **figures(bytes(codes), least, last, turns)})
                if not begun or conv != now:
                    now, codes, least, last, turns, begun = conv, bytearray(), None, None, 0, True
                codes += own
                if first_turn is not None:
                    turns += n - (first_turn == last)
                    least, last = first_turn if least is None else least, last_turn
            yield pa.RecordBatch.from_pylist(out, schema)
        if begun:
            yield pa.RecordBatch.from_pylist([{"conv_id": now, **figures(bytes(codes), least, last, turns)}], schema)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = told = None
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *FIXED[-8:]])
            out = []
            for row in batch.to_pylist():
                if row["part"] == -1:
                    if head is not None:
                        out.append({**head, "repaired_sha256": told.hexdigest()})
                    head, told = {c: row[c] for c in ("conv_id", *FIELDS[:-1])}, Repaired(row["audit"])
                else:
                    for role, text in zip(row["roles"], row["texts"], strict=True):
                        told.row(role, text)
            yield pa.RecordBatch.from_pylist(out, schema)
        if head is not None:
            yield pa.RecordBatch.from_pylist([{**head, "repaired_sha256": told.hexdigest()}], schema)

    codes = chunks.select(*place, "codes", "first_turn", "last_turn", "turns").repartition("conv_id").sortWithinPartitions(*place)
    heads = codes.mapInArrow(audited, f"conv_id {kind}, {RESULT.rpartition(', ')[0]}")
    heads = store.written(heads, "repair-heads").withColumns({"part": F.lit(-1), "chunk": F.lit(0)})
    both = heads.unionByName(chunks.select(*place, "roles", "texts"), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(*place).mapInArrow(passed, f"conv_id {kind}, {RESULT}")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(store.table(spark, sf_dir, "conversations")))


def _edited(state: str, cost: str, letter: str, item: str = "''") -> str:
    """SQL: a state's text (cost in nine digits, audit, a mark, repaired rows) after one edit."""
    return f"printf('%09d', left({state}, 9)::INTEGER + {cost}) || substr(split_part({state}, chr(1), 1), 10) || '{letter}' || chr(1) || substr({state}, strpos({state}, chr(1)) + 1) || {item}"


def _closed(z: str, s: str, u: str, a: str) -> str:
    """SQL: the four states' columns from a row source ``f`` with inserts taken in."""
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    inner = f"SELECT *, least(u0, {_edited('z', '2', 'I', user)}, {_edited('s', '2', 'I', user)}, {_edited('a0', '2', 'I', user)}) AS u FROM ({{source}})"
    return f"SELECT conv_id, p, z, s, u, least(a0, {_edited('u', '2', 'I', assistant)}) AS a FROM ({inner})".replace("{source}", f"SELECT f.*, {z} AS z, {s} AS s, {u} AS u0, {a} AS a0 FROM f")


def op11_sql() -> str:
    """The same rows in DuckDB's SQL: a forward table of the cheapest edits by state, row by row."""
    kept = "chr(10) || role || ':' || text"
    cases = lambda *c: "least(" + ", ".join(c) + ")"
    keep = lambda x, i: f"CASE WHEN NOT must AND initial = '{i}' THEN {_edited(x, 'cut', 'K', kept)} END"
    role = lambda x, name: f"CASE WHEN NOT must THEN {_edited(x, '(2 + cut)', 'R', f"chr(10) || '{name}:' || text")} END"
    gone = lambda x: _edited(x, "3", "D")
    users = [e for x in ("oz", "os", "oa") for e in (keep(x, "u"), role(x, "user"))]
    step = _closed(gone("oz"), cases(gone("os"), keep("oz", "s")), cases(gone("ou"), *users), cases(gone("oa"), keep("ou", "a"), role("ou", "assistant")))
    begin = _closed("'000000000' || chr(1)", "NULL::VARCHAR", "NULL::VARCHAR", "NULL::VARCHAR")
    return f"""
WITH RECURSIVE hashed AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS b FROM conversations
), kinds AS (
  SELECT rid, conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x:
    list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda h, k: xor(h >> 1, 3988292384 * (h & 1)))), 4294967295) % 20 AS kind FROM hashed
), damaged AS (
  SELECT rid, conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds
), ranked AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, rid, copy) AS p,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, rid, copy) > 1 AS again,
    NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS white, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS short FROM damaged
), coded AS (
  SELECT *, white OR again AS must, (short AND NOT white AND NOT again)::INTEGER AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY p) AS former FROM ranked
), counted AS (
  SELECT conv_id, max(p) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (white) AS blank, count(*) FILTER (again AND NOT white) AS duplicate,
    sum(cut)::BIGINT AS truncated, count(*) FILTER (p > 1 AND former || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY conv_id
), begun AS (
  WITH f AS (SELECT conv_id, 0::BIGINT AS p FROM counted) {begin}
), walk AS (
  SELECT * FROM begun
  UNION ALL (
    WITH f AS (SELECT c.*, w.z AS oz, w.s AS os, w.u AS ou, w.a AS oa FROM walk AS w JOIN coded AS c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND c.p = w.p + 1) {step}
  )
), ended AS (
  SELECT c.*, least(w.z, w.a) AS best FROM counted AS c JOIN walk AS w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.p = c.n
)
SELECT o.conv_id, coalesce(e.gaps, 0) AS gaps, coalesce(e.blank, 0) AS blank, coalesce(e.duplicate, 0) AS duplicate, coalesce(e.truncated, 0) AS truncated, coalesce(e.illegal, 0) AS illegal,
  coalesce(left(e.best, 9)::BIGINT, 0) AS cost, coalesce(substr(split_part(e.best, chr(1), 1), 10), '') AS audit, sha256(coalesce(substr(e.best, strpos(e.best, chr(1)) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN ended AS e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""
