"""Operator 7, near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find grouping.

A document's set holds the distinct shingles of ``size`` words (A-Z lower-cased, words split at ASCII white space);
a shorter text is one shingle; a text without words has an empty set and is linked with nothing. Two documents are
linked when 100 * intersection >= percent * union, decided on the full sets; groups are the connected components.

Plan:
1. one pass makes per document a fingerprint of its set and the hashes of its signature's bands (no text moves);
2. equal sets collapse into one class, named by its smallest doc_id;
3. classes that share a band are joined to the band's smallest member, and the components of these candidate links
   are *neighbourhoods*: unverified, but every true link lies within one of them;
4. only members of neighbourhoods are read again and dealt into blocks of ``block`` documents. A block is compared with itself
   and with up to ``pivots`` members that all blocks of the neighbourhood get; intersections are exact, by a matrix product, and a
   spanning forest of the links is kept. Members tied to the pivots' largest group are settled, as pairs within one group
   decide nothing. Only the others meet the neighbourhood's other blocks. So a group of n near copies costs n * ``block``
   comparisons in n / ``block`` tasks, m outsiders of it n * m more, and no list of all pairs exists;
5. components of the verified links give the groups.

SuperMinHash: element e gives register pi_e(j) the value (j, r_j), pi_e a permutation drawn step by step; a document
stops at the first step j that no register still waits for, so long texts take two or three steps.
With the default 32 bands of 7 registers a pair at the threshold 0.85 misses all bands with probability 4e-6.

Defined cases: null text is an empty set; null doc_id: the row can't name a group and gets the component of its class
if a numbered document has the same set, else null; repeated rows get equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaprobe.llm import store, words


ELEMENTS = 1 << 18  # of a text are drawn at a time, m bytes each


@dataclass(frozen=True)
class Near:
    size: int = 3
    percent: int = 85
    bands: int = 32
    rows: int = 7
    block: int = 256
    pivots: int = 16
    broadcast_ids: int = 1_000_000  # member lists up to this many rows (at most 40 MB) are broadcast, longer ones shuffled


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin."""
    codes, starts, distinct = words.split(texts, lower=True)
    value = words.word_hashes(distinct)[codes] if len(codes) else np.empty(0, np.uint64)
    hashes, at = words.windows(value, starts, size)
    counts = np.diff(starts)
    owners = words.owner(starts)[at] if len(at) else np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for k, row in enumerate(short.tolist()):
            total = np.array([counts[row]], np.uint64)
            for x in value[starts[row] : starts[row + 1]]:
                total = words.mixed(total ^ x)
            whole[k] = words.mixed(total)[0]
        hashes, owners = np.concatenate([hashes, whole]), np.concatenate([owners, short])
        order = np.argsort(owners, kind="stable")
        hashes, owners = hashes[order], owners[order]
    ends = np.cumsum(np.bincount(owners, minlength=len(counts)))
    for a, b in zip((ends - np.bincount(owners, minlength=len(counts))).tolist(), ends.tolist(), strict=True):
        hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[fresh], np.concatenate([[0], np.cumsum(np.bincount(owners[fresh], minlength=len(counts)))]).astype(np.int64)


def super_minhash(values: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """Signatures (one row of ``m`` registers for each set) of distinct values; rows of empty sets stay at the maximum."""
    n = len(starts) - 1
    out = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    owners = words.owner(starts)
    for a in range(0, len(values), ELEMENTS):
        lowered(out, values[a : a + ELEMENTS], owners[a : a + ELEMENTS], m)
    return out.reshape(n, m)


def lowered(out: np.ndarray, values: np.ndarray, owners: np.ndarray, m: int) -> None:
    """Lower the registers ``out`` (of all sets, in a row) by some elements; what is full by earlier ones stops the sooner."""
    first, last = int(owners[0]), int(owners[-1]) + 1
    live = np.arange(len(values))
    order = np.broadcast_to(np.arange(m, dtype=np.uint16 if m > 256 else np.uint8), (len(values), m)).copy()
    for j in range(m):
        if not len(live):
            break
        draw = words.mixed(values[live] ^ words.mixed(np.array([j + 1], np.uint64))[0])
        k = j + ((draw >> np.uint64(40)) * np.uint64(m - j) >> np.uint64(24)).astype(np.int64)
        register = order[live, k].astype(np.int64)
        order[live, k] = order[live, j]
        rank = np.uint64(j) << np.uint64(40)
        np.minimum.at(out, owners[live] * m + register, rank | (draw & np.uint64((1 << 40) - 1)))
        waits = out.reshape(-1, m)[first:last].max(axis=1) > (np.uint64(j + 1) << np.uint64(40))
        live = live[waits[owners[live] - first]]


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        total = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            total = words.mixed(total ^ signature[:, b * rows + r])
        out[:, b] = total
    return out


def set_prints(values: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Two order-free 64-bit sums per set."""
    n = len(starts) - 1
    some = np.flatnonzero(np.diff(starts))
    out = []
    for seed in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.zeros(n, np.uint64)
        if len(some):
            total[some] = np.add.reduceat(words.mixed(values ^ np.uint64(seed)), starts[:-1][some])
        out.append(total.view(np.int64))
    return out


def _signed(docs: DataFrame, near: Near) -> DataFrame:
    m = near.bands * near.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text", 2 << 20):
                values, starts = shingles(part.column("text"), near.size)
                bands = band_hashes(super_minhash(values, starts, m), near.bands, near.rows).view(np.int64)
                one, two = set_prints(values, starts)
                offsets = pa.array(np.arange(0, bands.size + 1, near.bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(starts)), pa.array(one), pa.array(two), pa.ListArray.from_arrays(offsets, pa.array(bands.ravel()))],
                    names=["doc_id", "n_shingles", "one", "two", "bands"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, one bigint, two bigint, bands array<bigint>"
    )


def linked_sets(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of ``left`` and ``right`` (places in ``sets``) are linked, as a symmetric matrix over all sets."""
    sizes = np.array([len(x) for x in sets], np.int64)
    owners = np.repeat(np.arange(len(sets)), sizes)
    _, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    held = counts[code] > 1
    code, owners = shared[code[held]], owners[held]
    common = np.zeros((len(left), len(right)), np.float32)
    width = 8192
    order = np.argsort(code, kind="stable")
    code, owners = code[order], owners[order]
    for base in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [base, base + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[owners[a:b], code[a:b] - base] = 1
        common += dense[left] @ dense[right].T
    joined = sizes[left][:, None] + sizes[right][None, :] - common
    linked = np.zeros((len(sets), len(sets)), bool)
    linked[np.ix_(left, right)] = 100 * common >= percent * joined
    return linked | linked.T


def forest(linked: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Components of a symmetric matrix (each named by its first place) and the links of a spanning forest."""
    name = np.full(len(linked), -1)
    found: list[tuple[int, int]] = []
    for seed in range(len(linked)):
        if name[seed] >= 0:
            continue
        name[seed] = seed
        queue = [seed]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(linked[at] & (name < 0))
            name[new] = seed
            found += [(at, int(x)) for x in new]
            queue += new.tolist()
    return name, found


def arrow_sets(group: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]


def without_repeats(group: pa.Table, kind: str) -> pa.Table:
    """Rows of repeated documents go; different texts of one id stay."""
    rows = list(zip(*(group.column(c).to_pylist() for c in ("id", kind, "shingles")), strict=True))
    return group.take(pa.array(list({row: i for i, row in enumerate(rows)}.values()), pa.int64()))


def links_of_block(group: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """FIRST of one block with its neighbourhood's pivots: a spanning forest of its links, and the block's members that are not tied
    to the pivots' largest group (which all blocks find alike, by the pivots alone)."""
    group = without_repeats(group, "pivot")
    ids, own, pivot = (group.column(c).to_numpy() for c in ("id", "own", "pivot"))
    every = np.arange(len(ids))
    linked = linked_sets(arrow_sets(group), every, every, percent)
    name, found = forest(linked)
    rest = np.empty(0, np.int64)
    if pivot.any():
        at = np.flatnonzero(pivot)
        among, _ = forest(linked[np.ix_(at, at)])
        sizes = np.bincount(among)
        best = min(np.unique(among).tolist(), key=lambda g: (-sizes[g], ids[at][among == g].min()))  # rows come in no order: ties go by id
        settled = name == name[at[best]]
        rest = np.flatnonzero(~settled & (own == group.column("dealt")[0].as_py()))
    u = np.concatenate([ids[[a for a, _ in found]], ids[rest]]) if len(found) else ids[rest]
    v = [int(ids[b]) for _, b in found] + [None] * len(rest)
    shingles = [None] * len(found) + group.column("shingles").take(pa.array(rest)).to_pylist()
    place, blocks = (np.full(len(u), group.column(c)[0].as_py()) for c in ("place", "blocks"))
    yield pa.RecordBatch.from_arrays(
        [pa.array(place, pa.int64()), pa.array(blocks, pa.int32()), pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(shingles, pa.binary())],
        names=["place", "blocks", "u", "v", "shingles"],
    )


def links_across(group: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """u, v: a spanning forest of the links between a block's members and unsettled ones."""
    group = without_repeats(group, "unsettled")
    ids, unsettled = group.column("id").to_numpy(), group.column("unsettled").to_numpy()
    found = forest(linked_sets(arrow_sets(group), np.flatnonzero(unsettled), np.flatnonzero(~unsettled), percent))[1]
    u, v = (pa.array([int(ids[link[side]]) for link in found], pa.int64()) for side in (0, 1))
    yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"])


FIRST = "place bigint, blocks int, u bigint, v bigint, shingles binary"


def grouped(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    signed = store.written(_signed(docs, near), "near-signed")
    full = signed.where("n_shingles > 0")
    classes = full.groupBy("one", "two", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.count("*").alias("rows"))
    classes = classes.where("id is not null")
    classes = store.written(classes, "near-classes")
    banded = classes.select("id", F.explode("bands").alias("band"))
    first = banded.groupBy("band").agg(F.min("id").alias("lead"), F.max("id").alias("last"), F.count("*").alias("n")).where("lead < last").drop("last")
    total = classes.count()
    near_by = store.joined_by_share(banded, first, ["band"], total * near.bands, F.xxhash64("id"))
    near_by = near_by.where("id > lead").select(F.col("id").alias("u"), F.col("lead").alias("v"))
    placed = store.written(store.components(near_by, "near-candidates").select(F.col("node").alias("id"), F.col("root").alias("place")), "near-placed")
    sizes = placed.groupBy("place").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / near.block).cast("int"))
    placed = store.joined_by_share(placed, sizes, ["place"], total, F.xxhash64("id"))
    pivots = placed.where("blocks > 1").groupBy("place", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(near.pivots))).agg(F.min_by("id", F.xxhash64("id")).alias("id"))
    members = placed.join(pivots.select("id", F.lit(True).alias("pivot")), "id", "left").withColumn("pivot", F.coalesce("pivot", F.lit(False)))
    members = store.written(members.join(classes.select("id", "one", "two"), "id"), "near-members")
    links = _verified(docs, members, near, total)
    found = store.components(links, "near-links").select(F.col("node").alias("id"), "root")
    named = classes.drop("bands").join(found, "id", "left").select(
        "one", "two", "n_shingles", F.coalesce("root", "id").alias("component"), F.col("rows").alias("n")
    )
    keys = ["one", "two", "n_shingles"]
    return (
        store.joined_by_share(signed.drop("bands"), named, keys, signed.count(), F.xxhash64("doc_id"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    )


def _verified(docs: DataFrame, members: DataFrame, near: Near, total: int) -> DataFrame:
    """(u, v): links between classes of a neighbourhood, decided on the full sets; ``total`` is the number of classes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            for part in words.slices(batch, "text", 2 << 20):
                values, starts = shingles(part.column("text"), near.size)
                one, two = set_prints(values, starts)
                own = (one == part.column("one").to_numpy()) & (two == part.column("two").to_numpy())
                keys = list(zip(part.column("id").to_pylist(), one.tolist(), strict=True))
                rows = [r for r in np.flatnonzero(own).tolist() if keys[r] not in seen and not seen.add(keys[r])]  # repeats go
                raw = [values[starts[r] : starts[r + 1]].tobytes() for r in rows]
                kept = part.select(["place", "id", "blocks", "pivot"]).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(raw, pa.binary())], names=[*kept.schema.names, "shingles"])

    side = members if members.count() > near.broadcast_ids else F.broadcast(members)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(side, "id").select("id", "text", "place", "blocks", "pivot", "one", "two")
    full = store.written(texts.mapInArrow(sets, "place bigint, id bigint, blocks int, pivot boolean, shingles binary"), "near-sets")
    full = full.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = full.withColumn("dealt", F.explode(F.when(F.col("pivot"), every).otherwise(F.array("own"))))
    found = store.written(store.per_run(dealt, ["place", "dealt"], lambda group: links_of_block(group, near.percent), FIRST), "near-first")
    links, rest = found.where("v is not null").select("u", "v"), found.where("v is null").select("place", "blocks", F.col("u").alias("id"), "shingles")
    if rest.isEmpty():
        return links
    left = rest.groupBy("place").agg(F.count("*").alias("n"), F.first("blocks").alias("blocks")).withColumn("parts", F.ceil(F.col("n") / near.block).cast("int"))
    left = store.written(left, "near-rest")
    unsettled = store.joined_by_share(rest.drop("blocks"), left, ["place"], total, F.xxhash64("id"))
    unsettled = unsettled.select("place", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(every).alias("own"), "id", "shingles", F.lit(True).alias("unsettled"))
    whole = left.select("place", "parts", (F.col("blocks") * near.block).alias("n"))
    against = store.joined_by_share(full.select("place", "own", "id", "shingles"), whole, ["place"], total, F.xxhash64("id"))
    against = against.select("place", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "own", "id", "shingles", F.lit(False).alias("unsettled"))
    across = store.per_run(unsettled.unionByName(against), ["place", "part", "own"], lambda group: links_across(group, near.percent), "u bigint, v bigint")
    return links.unionByName(across)


def one_of_each(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """Stage form: of each group only the document with the smallest doc_id stays, of repeated rows (equal id and text) one."""
    found = store.written(grouped(docs, near).select("doc_id", "kept"), "near-verdicts")
    gone = found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    out = docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)  # one plan at every size, texts aren't sorted
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return out
    again = store.written(again, "near-repeated")
    twice = out.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return out.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(twice)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(store.table(spark, sf_dir, "documents"))
