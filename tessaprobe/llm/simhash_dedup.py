"""Operator 13, SimHash near-dedup: fingerprints in Gray order under a hierarchy of masked bit patterns, union-find grouping.

A text (A-Z lower-cased, words split at ASCII white space) gives its shingles of ``size`` words, repeats included, joined by a space; with fewer
words the whole sequence is the one shingle, without words the fingerprint is zero and linked like any other. Bit k of a fingerprint
is 1 if it is set in over half the shingles' XXH64. Fingerprints are linked if at most ``distance`` of their 64 bits
differ; groups are the connected components.

Plan:
1. one pass over the texts makes fingerprints; equal ones collapse into one class, so copies cost nothing from here on;
2. upper nodes of the index are masked bit patterns: the free bits are cut into ``distance`` + 1 parts, and of two linked fingerprints one part must
   agree. A fingerprint goes below one node for each part. A node with over ``most`` members is cut again, over its free bits and
   with the same argument, until all nodes are small: no node is ever one task's unbounded work, no member is left out, and nodes of
   ``tail`` free bits hold at most 2 ** tail distinct fingerprints;
3. a node's members are sorted by Gray rank, so neighbours share many bits. Runs of ``leaf`` of them are the leaves, runs of ``fan`` leaves
   the level above; each keeps the mask and pattern of the bits all its members share. Two nodes whose patterns differ in more than
   ``distance`` commonly masked bits are pruned with all below them, else their children are compared (a child's mask contains its
   parent's, so differences accumulate), down to XOR and bit counts between members. Only a spanning forest of the links leaves the task;
4. components of the links give the groups, named by the smallest doc_id.

Defined cases: null text is a text without words; a row with a null doc_id links like any other but can't name a group: its group's
smallest doc_id is its component, null if the group has none; repeated rows give equal rows; a text of any length is hashed in pieces; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaprobe.llm import store, words

BITS = 64
PIECE = 1 << 16  # shingles hashed at a time
WHITE = re.compile(rb"[\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Sim:
    size: int = 3
    seed: int = 42
    distance: int = 3
    most: int = 4096  # members of an index node that one task compares
    tail: int = 12  # free bits at which a node isn't cut again
    leaf: int = 64
    fan: int = 8


def fingerprint(raw: bytes | None, size: int, seed: int) -> int:
    """Of one text in UTF-8, unsigned."""
    text = WHITE.sub(b" ", (raw or b"").lower()).strip(b" ")
    if not text:
        return 0
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    n = max(1, len(gaps) + 2 - size)
    starts = np.concatenate([[0], gaps[: n - 1] + 1])
    ends = np.concatenate([gaps[size - 1 :], [len(text)]])
    votes = np.zeros(BITS, np.int64)
    for a in range(0, n, PIECE):
        edges = zip(starts[a : a + PIECE].tolist(), ends[a : a + PIECE].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(text[s:e], seed) for s, e in edges], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """The place of each code in the binary reflected Gray sequence."""
    rank = prints.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def _signed(docs: DataFrame, sim: Sim) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("text").cast(pa.binary())
            found = np.array([fingerprint(x.as_py(), sim.size, sim.seed) for x in raw], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, print bigint")


def parts(free: list[int], n: int) -> list[list[int]]:
    """The free bits in ``n`` runs of nearly equal length."""
    return [x.tolist() for x in np.array_split(np.array(free, np.int64), min(n, len(free)))]


def signed(bits: list[int]) -> int:
    """A mask of bits as a signed 64-bit number."""
    mask = sum(1 << b for b in bits)
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _below(classes: DataFrame, sim: Sim) -> DataFrame:
    """node, value, print: below which upper nodes each fingerprint stands, nodes of more than ``most`` members cut again."""
    spark = classes.sparkSession
    level, out = {0: []}, None  # a node's number -> the bits that agree below it
    rows = classes.select(F.lit(0).alias("node"), F.lit(0).cast("bigint").alias("value"), "print")
    while True:
        children, masks = {}, []
        for node, fixed in level.items():
            for k, part in enumerate(parts([b for b in range(BITS) if b not in fixed], sim.distance + 1)):
                own = node * (sim.distance + 1) + k + 1
                children[own] = fixed + part
                masks.append((node, own, signed(children[own])))
        level = children
        cut = spark.createDataFrame(masks, "node int, child int, mask bigint")  # 4 rows, 16, 64, ..: at most 6 levels
        rows = rows.join(F.broadcast(cut), "node").select(F.col("child").alias("node"), F.col("print").bitwiseAND(F.col("mask")).alias("value"), "print")
        if BITS - min(len(x) for x in level.values()) <= sim.tail:
            return rows if out is None else out.unionByName(rows)
        large = store.written(rows.groupBy("node", "value").agg(F.count("*").alias("n")).where(F.col("n") > sim.most).select("node", "value"), "simhash-large")
        if large.isEmpty():
            return rows if out is None else out.unionByName(rows)
        kept = rows.join(large, ["node", "value"], "left_anti")
        out = kept if out is None else out.unionByName(kept)
        rows = store.written(rows.join(large, ["node", "value"], "left_semi"), "simhash-cut")


class Forest:
    """A spanning forest over places 0..n-1, from arrays of links."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)
        self.found: list[tuple[int, int]] = []

    def labels(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        labels = self.labels()
        a, b = labels[left], labels[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        new = np.flatnonzero(low != high)
        if not len(new):
            return
        _, first = np.unique(low[new] * len(labels) + high[new], return_index=True)
        for at in new[first].tolist():
            x, y = int(a[at]), int(b[at])
            while self.parent[x] != x:
                x = int(self.parent[x])
            while self.parent[y] != y:
                y = int(self.parent[y])
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.found.append((int(left[at]), int(right[at])))


def shared_bits(ones: np.ndarray, some: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of nodes: the bits set in all members and those set in some, from the same of the level below."""
    return np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(some, starts)


def near_nodes(ones: np.ndarray, some: np.ndarray, left: np.ndarray, right: np.ndarray, distance: int) -> np.ndarray:
    """Which of the pairs of nodes may hold linked members: few differences in the bits that both masks have."""
    both = ~(ones[left] ^ some[left]) & ~(ones[right] ^ some[right])
    return np.bitwise_count((ones[left] ^ ones[right]) & both) <= distance


def linked_below(prints: np.ndarray, base: int, sim: Sim, forest: Forest) -> None:
    """Links among the members of one upper node, sorted by Gray rank, by way of leaves and the level above them."""
    n = len(prints)
    leaves = np.arange(0, n, sim.leaf)
    ones, some = shared_bits(prints, prints, leaves)
    tops = np.arange(0, len(leaves), sim.fan)
    a, b = np.triu_indices(len(tops))
    live = near_nodes(*shared_bits(ones, some, tops), a, b, sim.distance)
    for top, other in zip(a[live].tolist(), b[live].tolist(), strict=True):
        x, y = np.arange(tops[top], min(tops[top] + sim.fan, len(leaves))), np.arange(tops[other], min(tops[other] + sim.fan, len(leaves)))
        i, j = (m.ravel() for m in np.meshgrid(x, y, indexing="ij"))
        keep = (i <= j) & near_nodes(ones, some, i, j, sim.distance)
        for p, q in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            one, two = prints[leaves[p] : leaves[p] + sim.leaf], prints[leaves[q] : leaves[q] + sim.leaf]
            r, s = np.nonzero(np.bitwise_count(one[:, None] ^ two[None, :]) <= sim.distance)
            forest.add(base + leaves[p] + r, base + leaves[q] + s)


def links_of_nodes(node: np.ndarray, value: np.ndarray, prints: np.ndarray, sim: Sim) -> np.ndarray:
    """Pairs of places: a spanning forest of the links within each upper node; rows come sorted by node and value."""
    order = np.lexsort((gray_rank(prints), value, node))
    node, value, prints = node[order], value[order], prints[order]
    new = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (value[1:] != value[:-1])]))
    sizes = np.diff(np.concatenate([new, [len(node)]]))
    forest = Forest(len(node))
    left = np.repeat(sizes, sizes) - (np.arange(len(node)) - np.repeat(new, sizes))  # members from here to the end of the node
    left[np.repeat(sizes > sim.leaf, sizes)] = 0
    for k in range(1, min(int(sizes.max()), sim.leaf)):  # nodes of one leaf, all at once
        at = np.flatnonzero(left > k)
        at = at[np.bitwise_count(prints[at] ^ prints[at + k]) <= sim.distance]
        forest.add(at, at + k)
    for g in np.flatnonzero(sizes > sim.leaf).tolist():
        linked_below(prints[new[g] : new[g] + sizes[g]], int(new[g]), sim, forest)
    return order[np.array(forest.found, np.int64).reshape(-1, 2)]


def _links(placed: DataFrame, sim: Sim) -> DataFrame:
    """u, v: linked fingerprints, enough of them to connect each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            own = [batch.column(c).to_numpy().astype(np.int64) for c in ("node", "value", "print")]
            held = [np.concatenate(x) for x in zip(held, own, strict=True)]
            if len(held[0]):
                last = int(np.flatnonzero((held[0] == held[0][-1]) & (held[1] == held[1][-1]))[0])  # its node may go on
                yield from linked(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        yield from linked(*held)

    def linked(node: np.ndarray, value: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(node):
            pairs = prints[links_of_nodes(node, value, prints.view(np.uint64), sim)]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return placed.repartition("node", "value").sortWithinPartitions("node", "value").mapInArrow(run, "u bigint, v bigint")


def grouped(docs: DataFrame, sim: Sim = Sim()) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of ``docs``."""
    prints = store.written(_signed(docs, sim), "simhash-prints")
    classes = store.written(prints.groupBy("print").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "simhash-classes")
    links = _links(_below(classes.select("print"), sim), sim)
    roots = store.components(links, "simhash-links").withColumnRenamed("node", "print")
    named = store.written(classes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")), "simhash-named")
    groups = named.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("n"))
    members = store.joined_by_share(named.withColumnRenamed("n", "rows"), groups, ["root"], named.count(), F.xxhash64("print"))
    members = members.select("print", "component_id", F.col("rows").alias("n"))
    found = store.joined_by_share(prints, members, ["print"], prints.count(), F.xxhash64("doc_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(store.table(spark, sf_dir, "documents"))
