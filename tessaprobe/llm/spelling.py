"""Operator 12, spelling variant grouping: dense prefix-suffix tiling of words that differ by one edit.

Words are the maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts, only A-Z lower-cased. A run whose crc32 of ``<doc_id>:<run>`` the number
``damage`` divides loses one code point (its place: crc32 mod length). The vocabulary holds the results of at least ``least_length`` code points
and ``least_count`` occurrences. Two of its words are near if one inserted, deleted or replaced code point tells them apart, which is so
exactly if common prefix and common suffix together reach the longer length minus one. A word's form is its near word of the largest count (ties:
the smallest in code-point order), if that count is at least ``ratio`` times its own; its root is the end of the chain of forms.

Plan:
1. one pass counts runs, per task first, so only distinct words are shuffled;
2. the place of an edit in the longer word, 0 .. m - 1, lies in its first or its second half; outside this half the two words agree. So a word goes into
   groups by what it has outside each half, once as the longer (m its length) and once as the shorter one (m its length plus one). A group of more
   than ``most`` words is cut again, at the half of its half, until groups are small or one place is left, where
   at most the alphabet can differ. No group is cut short and no pair lost, however many words share a beginning;
3. a task packs groups of equal m into tiles of ``tile`` rows: code points padded to m, once from the front and once from the back. Tile against
   tile, the first mismatch from either side gives prefix and suffix lengths of all pairs at once. A pair counts only in the group whose
   part holds the end of its common prefix, so it is found once;
4. per word the near words are counted and the largest kept; roots by doubling jumps along forms, whose counts grow ``ratio``-fold each step.

Defined cases: null text has no words; a null doc_id counts as empty text in the crc32; repeated rows count each time; a run of any length is a word
(tiles of long words have fewer rows); an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaprobe.llm import store, words

RUN = re.compile("[a-zÀ-ÿ]+")  # of texts whose A-Z are lower-cased
HELD_WORDS = 1 << 18  # distinct words a task counts before it hands them on
PAIR_BYTES = 1 << 24  # of a comparison of two tiles


@dataclass(frozen=True)
class Spelling:
    damage: int = 199
    least_length: int = 6
    least_count: int = 5
    ratio: int = 5
    most: int = 2048  # words of a group that one task compares
    tile: int = 64


def damaged(run: str, doc: int, damage: int) -> str:
    """The run, or without one code point; ``doc`` is the crc32 of ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), doc)
    if h % damage:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counts(docs: DataFrame, rule: Spelling = Spelling()) -> DataFrame:
    """word, n over all texts, after damage; words shorter than ``least_length`` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for part in words.slices(batch, "text"):
                texts = pc.ascii_lower(pc.fill_null(part.column("text"), ""))
                for doc, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word, n in Counter(RUN.findall(text.as_py())).items():
                        if len(word) >= rule.least_length:  # no damage lengthens a run
                            total[damaged(word, seed, rule.damage)] += n
                if len(total) > HELD_WORDS:
                    yield counted(total)
                    total.clear()
        yield counted(total)

    def counted(total: Counter[str]) -> pa.RecordBatch:
        kept = {w: n for w, n in total.items() if len(w) >= rule.least_length}
        return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], names=["word", "n"])

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _cut(rows: DataFrame) -> DataFrame:
    """Each row (word, n, m, low, high: the part of 0 .. m - 1 with the edit) once for each half of its part, with the group's key:
    what the word has before and after it. The end is counted from the right, so words of m and m - 1 code points meet."""
    half = F.expr("low + div(high - low + 1, 2)")
    twice = rows.select("word", "n", "m", F.explode(F.array(F.struct(F.col("low"), half.alias("high")), F.struct(half.alias("low"), F.col("high")))).alias("part"))
    twice = twice.select("word", "n", "m", "part.*").where("low < high")
    after = F.expr("right(word, m - high)")
    return twice.withColumn("key", F.xxhash64("m", "low", "high", F.expr("left(word, low)"), F.when(F.col("m") > F.col("high"), after).otherwise("")))


def groups(vocabulary: DataFrame, most: int) -> DataFrame:
    """word, n, m, low, high, key: all groups, each of at most ``most`` words or with a part of one place."""
    m = F.char_length("word")
    rows = vocabulary.select("word", "n", F.explode(F.array(m, m + 1)).alias("m"), F.lit(0).alias("low")).withColumn("high", F.col("m"))
    out = None
    while True:
        rows = _cut(rows)
        large = rows.where("high - low > 1").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key")
        large = store.written(large, "spelling-large")
        if large.isEmpty():
            return rows if out is None else out.unionByName(rows)
        kept = rows.join(large, "key", "left_anti").select("word", "n", "m", "low", "high", "key")
        out = kept if out is None else out.unionByName(kept)
        rows = store.written(rows.join(large, "key", "left_semi").select("word", "n", "m", "low", "high"), "spelling-cut")


def matrix(listed: list[str], m: int) -> np.ndarray:
    """Code points of words of at most ``m``, padded by zeros."""
    return np.frombuffer("".join(w.ljust(m, "\0") for w in listed).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(listed), m)


def first_mismatch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of ``a`` and of ``b`` the length of their common beginning."""
    same = a[:, None, :] == b[None, :, :]
    return np.where(same.all(axis=2), a.shape[1], same.argmin(axis=2))


class Tile:
    """Some consecutive rows of one m: code points from the front and from the back, lengths and group keys."""

    def __init__(self, listed: list[str], keys: np.ndarray, low: np.ndarray, high: np.ndarray, m: int) -> None:
        self.words, self.keys, self.low, self.high, self.m = listed, keys, low, high, m
        self.front, self.back = matrix(listed, m), matrix([w[::-1] for w in listed], m)
        self.long = np.fromiter((len(w) == m for w in listed), bool, len(listed))

    def near(self, other: Tile, shorter: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Places of near pairs: here a word of m code points, there one of m - 1 (``shorter``: only such) or m; within one tile
        words of m code points meet once."""
        rows = np.flatnonzero(self.long)
        ok = (self.keys[rows][:, None] == other.keys[None, :]) & (~other.long[None, :] if shorter else True)
        if other is self:
            ok &= ~other.long[None, :] | (rows[:, None] < np.arange(len(other.words))[None, :])
        if not ok.any():
            return rows[:0], rows[:0]
        prefix, suffix = first_mismatch(self.front[rows], other.front), first_mismatch(self.back[rows], other.back)
        ok &= (prefix + suffix >= self.m - 1) & (prefix >= self.low[rows][:, None]) & (prefix < self.high[rows][:, None])
        i, j = np.nonzero(ok)
        return rows[i], j


def near_pairs(rows: pa.Table, tile: int) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways, of whole groups, whose rows come sorted by m and key."""
    m, key, low, high = (rows.column(c).to_numpy() for c in ("m", "key", "low", "high"))
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (m[1:] != m[:-1])]))
    sizes = np.diff(np.concatenate([new, [len(m)]]))
    some = np.repeat(sizes > 1, sizes)  # a word alone in its group has no partner there
    rows, m, key, low, high = rows.filter(pa.array(some)), m[some], key[some], low[some], high[some]
    ends = np.cumsum(sizes[sizes > 1])
    last_of_m = np.concatenate([np.flatnonzero(m[1:] != m[:-1]) + 1, [len(m)]])
    listed, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def cut(a: int, b: int) -> Tile:
        return Tile(listed[a:b], key[a:b], low[a:b], high[a:b], int(m[a]))

    start = 0
    while start < len(m):
        width = max(1, min(tile, math.isqrt(PAIR_BYTES // int(m[start]))))
        most = min(start + width, int(last_of_m[np.searchsorted(last_of_m, start, side="right")]))
        whole = np.searchsorted(ends, most, side="right") - 1  # the last group that ends within the tile
        if whole >= 0 and ends[whole] > start:
            stop = int(ends[whole])
            i, j = (one := cut(start, stop)).near(one)
            found.append((start + i, start + j))
        else:  # a group of several tiles
            stop = int(ends[whole + 1])
            tiles = [(a, cut(a, min(a + width, stop))) for a in range(start, stop, width)]
            for p, (a, one) in enumerate(tiles):
                for b, two in tiles[p:]:
                    i, j = one.near(two)
                    found.append((a + i, b + j))
                    if one is not two:
                        i, j = two.near(one, shorter=True)
                        found.append((b + i, a + j))
        start = stop
    if found:
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        word = rows.column("word").combine_chunks()
        left, right = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
        yield pa.RecordBatch.from_arrays([word.take(left), word.take(right), pa.array(n).take(right)], names=["word", "other", "n"])


def neighbours(vocabulary: DataFrame, rule: Spelling = Spelling()) -> DataFrame:
    """word, other, n (of the other): all near pairs of a vocabulary (word, n), both ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            m, key = held.column("m").to_numpy(), held.column("key").to_numpy()
            last = int(np.flatnonzero((m == m[-1]) & (key == key[-1]))[0])  # its group may go on
            if last:
                yield from near_pairs(held.slice(0, last), rule.tile)
                held = held.slice(last)
        if held is not None:
            yield from near_pairs(held, rule.tile)

    dealt = groups(vocabulary, rule.most)
    return dealt.repartition("m", "key").sortWithinPartitions("m", "key").mapInArrow(run, "word string, other string, n bigint")


def rooted(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): where the chain of forms ends. Each round doubles the steps taken."""
    now = forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
    while True:
        now = store.written(now, "spelling-roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = now.drop("moved").join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))


def variants(docs: DataFrame, rule: Spelling = Spelling()) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of the vocabulary."""
    vocabulary = store.written(counts(docs, rule).where(F.col("n") >= rule.least_count), "spelling-words")
    best = neighbours(vocabulary, rule).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "other")).alias("best"))
    best = best.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.n")).alias("other_n"))
    enough = F.col("other_n") >= rule.ratio * F.col("n")
    found = vocabulary.join(best, "word", "left").select(
        "word", F.when(enough, F.col("other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("other_n")).alias("form_n")
    )
    found = store.written(found, "spelling-forms")
    roots = rooted(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(store.table(spark, sf_dir, "documents"))


def op12_sql() -> str:
    """The same rows in DuckDB's SQL: pairs by the strings that deletions leave, crc32 bit by bit."""
    return """
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), counted AS (
  SELECT doc, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY doc, run
), bytes AS (
  SELECT doc, run, n, list_transform(range(octet_length(encode(doc || ':' || run))), lambda i: ('0x' || substr(hex(encode(doc || ':' || run)), 2 * i + 1, 2))::BIGINT) AS b FROM counted
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x:
    list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda h, k: xor(h >> 1, 3988292384 * (h & 1)))), 4294967295) AS h FROM bytes
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1
), vocabulary AS (
  SELECT word, n, length(word) AS size FROM words WHERE length(word) >= 6 AND n >= 5
), cut AS (
  SELECT word, n, size, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(size)) AS i FROM vocabulary)
), pairs AS (
  SELECT a.word, b.word AS other FROM cut AS a JOIN cut AS b ON a.size = b.size AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut AS a JOIN vocabulary AS b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cut AS a JOIN vocabulary AS b ON a.rest = b.word
), ranked AS (
  SELECT p.word, v.word AS other, v.n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, v.word) AS k
  FROM pairs AS p JOIN vocabulary AS v ON p.other = v.word
), formed AS (
  SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 5 * v.n THEN r.other END AS form, CASE WHEN r.n >= 5 * v.n THEN r.n END AS form_n
  FROM vocabulary AS v LEFT JOIN ranked AS r ON v.word = r.word AND r.k = 1
), steps AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT s.word, f.form FROM steps AS s JOIN formed AS f ON s.at = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n
FROM formed AS f JOIN steps AS s ON f.word = s.word JOIN formed AS last ON s.at = last.word WHERE last.form IS NULL
"""
