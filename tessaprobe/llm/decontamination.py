"""Operator 2, benchmark decontamination by greedy string tiling.

Tokens are runs of letters, digits and non-ASCII signs, A-Z lower-cased. Seeds are the runs of ``least_tile`` tokens of an item
(the whole item, if it is shorter); a document and an item are compared when they share seeds. Then tiles are marked: running
Karp-Rabin finds the matches of at least ``least_tile`` unmarked tokens, the longest are marked first, and the search
runs again until nothing is left; a token is in one tile at most. So a reordered passage is still covered, by several
tiles. The pair is reported when the tiles cover ``percent`` per cent of the item's tokens.

No pair that meets the threshold is missed: a tile of n tokens starts n - least_tile + 1 seeds, at least n / least_tile of them,
so tiles over c tokens need k = c / least_tile (rounded up) places of the item whose seeds the document has; of any n - k + 1 of
the item's n places one is among them. Hence an item is looked up by its n - k + 1 places of the rarest seeds only, and seeds
that many documents share cost nothing as long as the item has rarer ones.

Plan: the benchmark's seeds are written as a table, and as a sieve of 2^``sieve_bits`` bits, whatever their number. One pass over the
documents keeps of each text the stretches whose seeds pass the sieve; texts without one are done. Seeds are joined as a
shuffle, dealt in ``salts`` ways, so that a passage which a third of all documents hold is many tasks' work; then pairs meet
their stretches and items and are tiled. Neither table passes through the driver.

Defined cases: null and empty texts match nothing, items without a token are never matched; a null doc_id stays null;
repeated documents are reported each, repeated items too; of equally long matches the first in the item, then in the text, is
marked first; a very long text is one task's row, of which only such stretches are held; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaprobe.llm import store, words

GAP = (1 << 64) - 1  # stands between stretches; no token's hash


@dataclass(frozen=True)
class Tiling:
    least_tile: int = 3
    percent: int = 80
    sieve_bits: int = 24
    salts: int = 8


PAIRS = "doc_id bigint, item_id bigint, coverage double, tiles int, tiled_tokens int, item_tokens int, longest_tile int"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and where each text's begin."""
    plain = pc.replace_substring_regex(pc.fill_null(texts, ""), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    codes, starts, distinct = words.split(plain, lower=True)
    return (words.word_hashes(distinct)[codes] if len(codes) else np.empty(0, np.uint64)), starts


def tiles(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length) of each tile, longest first."""
    if not item or not text:
        return []
    free_item, free_text = [True] * len(item), [True] * len(text)
    least = min(least, len(item))
    found = []
    base, mask = 1_000_003, (1 << 61) - 1

    def rolled(seq: list[int], free: list[bool]) -> Iterator[tuple[int, int]]:
        """(hash, start) of each run of ``least`` free tokens, by a rolling hash."""
        drop = pow(base, least - 1, mask)
        value, held = 0, 0
        for i, x in enumerate(seq):
            if not free[i]:
                value = held = 0
                continue
            if held == least:
                value = (value - seq[i - least] * drop) % mask
                held -= 1
            value = (value * base + x) % mask
            held += 1
            if held == least:
                yield value, i - least + 1

    while True:
        at = defaultdict(list)
        for value, i in rolled(item, free_item):
            at[value].append(i)
        matches = []
        for value, j in rolled(text, free_text):
            for i in at.get(value, ()):
                if i and j and free_item[i - 1] and free_text[j - 1] and item[i - 1] == text[j - 1]:
                    continue  # part of a longer match
                k = 0
                while i + k < len(item) and j + k < len(text) and free_item[i + k] and free_text[j + k] and item[i + k] == text[j + k]:
                    k += 1
                if k >= least:
                    matches.append((k, i, j))
        if not matches:
            return found
        for k, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_item[i : i + k]) and all(free_text[j : j + k]):
                free_item[i : i + k] = [False] * k
                free_text[j : j + k] = [False] * k
                found.append((i, j, k))


def item_tables(benchmark: DataFrame, tiling: Tiling) -> tuple[DataFrame, DataFrame]:
    """Items (item, item_id, size, tokens) and their seeds (seed, item, place), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in words.slices(batch, "text"):
                value, starts = tokens(part.column("text"))
                raw = [value[i:j].tobytes() for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                sizes = np.diff(starts)
                seeds = [seeds_of(value[i:j], np.array([0, j - i]), min(tiling.least_tile, j - i))[0] for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                offsets = pa.array(np.cumsum([0, *map(len, seeds)]).astype(np.int32))
                flat = np.concatenate(seeds).view(np.int64) if seeds else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item + np.arange(part.num_rows)), part.column("item_id"), pa.array(sizes.astype(np.int32)), pa.array(raw, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                    names=["item", "item_id", "size", "tokens", "seeds"],
                )
                item += part.num_rows

    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(run, "item bigint, item_id bigint, size int, tokens binary, seeds array<bigint>")
    items = store.written(rows.where("size > 0"), "leak-items")
    return items.drop("seeds"), items.select("item", "size", F.posexplode("seeds").alias("place", "seed"))


def seeds_of(value: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return words.windows(value, starts, n) if n else (np.empty(0, np.uint64), np.empty(0, np.int64))


def sieve_of(seeds: DataFrame, bits: int) -> np.ndarray:
    """One bit for each value of the seeds' first ``bits`` bits; made of one such array per task, whatever the table's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, bool)
        for batch in batches:
            held[(batch.column("seed").to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] = True
        cells = np.packbits(held).reshape(-1, 1 << 12)
        some = np.flatnonzero(cells.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([cells[i].tobytes() for i in some.tolist()], pa.binary())], names=["cell", "data"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, data in zip(batch.column("cell").to_pylist(), batch.column("data").to_pylist(), strict=True):
                own = np.frombuffer(data, np.uint8)
                held[cell] = held[cell] | own if cell in held else own
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["cell", "data"])

    rows = seeds.select("seed").mapInArrow(run, "cell int, data binary").repartition("cell").mapInArrow(either, "cell int, data binary").collect()  # the sieve
    out = np.zeros((1 << bits >> 15, 1 << 12), np.uint8)
    for r in rows:
        out[r["cell"]] = np.frombuffer(bytes(r["data"]), np.uint8)
    return out.ravel()


def candidates(docs: DataFrame, sieve: np.ndarray, sizes: list[int], tiling: Tiling) -> DataFrame:
    """(row, doc_id, key, seeds, tokens): texts with a seed in the sieve, its distinct seeds there and the stretches that they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, shift = TaskContext.get().partitionId() << 36, np.uint64(64 - tiling.sieve_bits)
        for batch in batches:
            for part in words.slices(batch, "text"):
                value, starts = tokens(part.column("text"))
                owners, cover = words.owner(starts), np.zeros(len(value) + 1, np.int32)
                whose, which = [], []
                for n in sizes:
                    found, at = words.windows(value, starts, n)
                    place = (found >> shift).astype(np.int64)
                    some = np.flatnonzero(sieve[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)
                    np.add.at(cover, at[some], 1)
                    np.subtract.at(cover, at[some] + n, 1)
                    whose.append(owners[at[some]])
                    which.append(found[some])
                whose, which = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (whose, which))
                out = {k: [] for k in ("row", "at", "seeds", "tokens")}
                covered = np.cumsum(cover[:-1]) > 0
                order = np.argsort(whose, kind="stable")
                texts, begin = np.unique(whose[order], return_index=True)
                for t, i, j in zip(texts.tolist(), begin.tolist(), np.append(begin, len(order))[1:].tolist(), strict=True):
                    own, free = value[starts[t] : starts[t + 1]], covered[starts[t] : starts[t + 1]]
                    cut = np.flatnonzero(free[1:] & ~free[:-1]) + 1  # a gap before each stretch
                    kept = np.insert(own[free], np.cumsum(free)[cut] - 1, GAP)
                    out["row"].append(row + t)
                    out["at"].append(t)
                    out["seeds"].append(np.unique(which[order[i:j]]).view(np.int64))
                    out["tokens"].append(kept.astype(np.uint64).tobytes())
                if out["at"]:
                    offsets = pa.array(np.cumsum([0, *map(len, out["seeds"])]).astype(np.int32))
                    at = pa.array(out["at"], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(out["row"], pa.int64()), part.column("doc_id").take(at), part.column("key").take(at),
                            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out["seeds"]))), pa.array(out["tokens"], pa.binary()),
                        ],
                        names=["row", "doc_id", "key", "seeds", "tokens"],
                    )
                row += part.num_rows

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("bigint"), "text").alias("key"))
    return store.written(rows.mapInArrow(run, "row bigint, doc_id bigint, key bigint, seeds array<bigint>, tokens binary"), "leak-candidates")


def tiled(batches: Iterator[pa.RecordBatch], tiling: Tiling) -> Iterator[pa.RecordBatch]:
    """Pairs (doc_id, key, item_id, size, text tokens, item tokens) -> key and PAIRS of those whose tiles reach the share."""
    for batch in batches:
        for part in words.slices(batch, "text_tokens"):
            at, rows = [], []
            for i, (raw, own, size) in enumerate(zip(part.column("text_tokens").to_pylist(), part.column("item_tokens").to_pylist(), part.column("size").to_pylist(), strict=True)):
                item, text = np.frombuffer(own, np.uint64), np.frombuffer(raw, np.uint64)
                known = np.isin(text, item)
                # tokens that the item lacks part the text; shorter stretches between them can't hold a tile
                edges = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
                least, short = min(tiling.least_tile, size), []
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    if b - a >= least:
                        short += text[a:b].tolist() + [-1]
                found = tiles(item.tolist(), short, tiling.least_tile)
                covered = sum(k for *_, k in found)
                if found and 100 * covered >= tiling.percent * size:
                    at.append(i)
                    rows.append((covered / size, len(found), covered, size, max(k for *_, k in found)))
            if rows:
                coverage, count, covered, size, longest = zip(*rows, strict=True)
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(at), part.column("doc_id").take(at), part.column("item_id").take(at), pa.array(coverage, pa.float64()),
                        *(pa.array(x, pa.int32()) for x in (count, covered, size, longest)),
                    ],
                    names=["key", *(c.split()[0] for c in PAIRS.split(", "))],
                )


def leaks(docs: DataFrame, benchmark: DataFrame, tiling: Tiling) -> DataFrame:
    """key (of doc_id and text) and PAIRS."""
    items, seeds = item_tables(benchmark, tiling)
    sizes = [n for n in range(1, tiling.least_tile + 1) if not items.where(F.col("size") == n if n < tiling.least_tile else F.col("size") >= n).isEmpty()]
    held = candidates(docs, sieve_of(seeds, tiling.sieve_bits), sizes, tiling)
    asked = held.select("row", F.explode("seeds").alias("seed"))
    # how many texts have a seed; then an item's places, rarest seeds first
    common = seeds.join(asked.groupBy("seed").agg(F.count("*").alias("texts")), "seed")
    k = F.ceil(F.ceil(F.col("size") * tiling.percent / 100) / F.least(F.col("size"), F.lit(tiling.least_tile)))
    places = common.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("texts"), "seed", "place")))
    # places that no text has are the rarest of an item's n; so of the others the k - 1 most common aren't needed
    keys = places.where(F.col("rank") > k - 1).select("seed", "item").distinct()
    salts = F.explode(F.sequence(F.lit(0), F.lit(tiling.salts - 1)))
    salt = F.pmod(F.xxhash64("row"), F.lit(tiling.salts)).cast("int")
    pairs = asked.withColumn("salt", salt).join(keys.withColumn("salt", salts), ["seed", "salt"]).select("row", "item").distinct()
    met = pairs.join(held.select("row", "doc_id", "key", F.col("tokens").alias("text_tokens")), "row").withColumn("salt", salt)
    met = met.join(items.withColumnRenamed("tokens", "item_tokens").withColumn("salt", salts), ["item", "salt"])
    met = met.select("key", "doc_id", "item_id", "size", "text_tokens", "item_tokens")
    return met.mapInArrow(lambda batches: tiled(batches, tiling), "key bigint, " + PAIRS)


def contaminated(docs: DataFrame, benchmark: DataFrame, tiling: Tiling = Tiling()) -> DataFrame:
    """One row (PAIRS) for each document and benchmark item that it holds."""
    return leaks(docs, benchmark, tiling).drop("key")


def clean(docs: DataFrame, benchmark: DataFrame, tiling: Tiling = Tiling()) -> DataFrame:
    """Stage form: the documents that hold no benchmark item; the columns of ``docs`` are returned."""
    gone = store.written(leaks(docs, benchmark, tiling).select(F.col("key").alias("__key")).distinct(), "leak-verdicts")
    keyed = docs.withColumn("__key", F.xxhash64(F.col("doc_id").cast("bigint"), "text"))
    return keyed.join(gone.hint("shuffle_hash"), "__key", "left_anti").select(*docs.columns)  # one plan at every size, texts aren't sorted


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "benchmark"))
