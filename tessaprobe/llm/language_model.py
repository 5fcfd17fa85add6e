"""Operator 1, LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | history) * P(slot | class, history) * P(token | slot). The slots of a class are ``breadth`` *
types ** 1/4, so that classes and slots follow the counted vocabulary: the most frequent tokens fill classes of neighbours in
frequency, one token a slot; every other token has a class by its shape (letters beyond ASCII, last sign) and a slot by its
hash, in which its share is (c + 1) / (mass + types + 1). Both softmaxes are log-linear in features of the history: the token
before, the pair of tokens before (an n-gram), and for the class the one before the last, skipping what lies between. Histories
are 24-bit hashes, frequent tokens have one of their own; so rare tokens count as histories and as targets.

Training is by distributed gradient updates, where the rows of weights live: a token goes, with its history, to the bucket that
its history hashes to, so all rows of the token before and of the pair are in one bucket and see all their tokens; a bucket holds
about ``bucket_tokens`` tokens however large the corpus is, and buckets (with their weights) grow in number with it. Equal
tuples (history, token) are counted first. Weights start at 0 over the classes' and slots' shares in the corpus; then template by
template every row moves along its gradient c - e, counted less expected under the weights so far, by log((c + a) / (e + a)):
a gradient step on the scale of the weights, damped by ``a``. Scores of all tuples follow in the same task, in numpy batches,
and their sums go back to the documents. Nothing depends on how the input is split, on order or on chance.

Histories that are heavy are dealt on: those of a frequent token before by the token before that as well, and if that is
frequent too by the document's hash. A piece of a bucket beyond ``held_tokens`` is a model of its own.

Counts of tokens that make up at least one ``known``-th of the corpus (so at most ``known`` of them, 16 bytes each) go to every
task; rarer tokens' counts are joined, so the vocabulary has no cap.

base_score is the unigram log10 probability with one added to every count. Tokens are 64-bit word hashes. Defined cases:
null and empty texts have the end token only; a null id counts as empty text in the hold-out rule; repeated rows count
and are scored each; tokens of equal counts rank by hash; without training documents every count is 0, and score equals
base_score; an empty table gives an empty result; other columns are ignored; a very long text is a slice of its own, and its
tokens are spread over the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaprobe.llm import store, words

END = np.uint64(0x5EEDE0DE5EEDE0DE)
START = (1 << 24) - 1  # the history before a text; other histories are below
SHAPES = 16


@dataclass(frozen=True)
class Model:
    breadth: float = 2.0
    most_slots: int = 200
    before: float = 0.5  # damping a of the rows of the token before, of skips, and of pairs
    skip: float = 1.0
    pair: float = 0.5
    skip_tokens: int = 8  # a skip row has as many training tokens at least
    bucket_tokens: int = 1_000_000
    most_buckets: int = 1 << 14
    held_tokens: int = 2_000_000
    batch: int = 8192
    known: int = 1 << 20
    modulus: int = 7
    remainder: int = 2


def tail_shapes(distinct: pa.Array) -> np.ndarray:
    """0..15 for each word: which letters beyond ASCII, and what it ends with."""
    letters = np.zeros(len(distinct), np.int64)
    for k, pattern in ((3, r"[^\x00-\x7F]"), (2, r"[äöüßÄÖÜ]"), (1, r"[éèêëàâçùûôîïœÉÈÊÀÇ]")):
        letters[pc.match_substring_regex(distinct, pattern).to_numpy(zero_copy_only=False)] = k
    last = np.zeros(len(distinct), np.int64)
    for k, pattern in ((1, r"[.,;:!?]$"), (2, r"[0-9]$"), (3, r"[\x21-\x2B\x2D\x2F\x3C-\x3E\x40\x5B-\x60\x7B-\x7E]$")):
        last[pc.match_substring_regex(distinct, pattern).to_numpy(zero_copy_only=False)] = k
    return letters * 4 + last


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all tokens with the end tokens (code: the last distinct token), where texts start, token hashes, shapes."""
    codes, starts, distinct = words.split(texts, lower=True)
    hashes = np.concatenate([words.word_hashes(distinct), [END]])
    shapes = np.concatenate([tail_shapes(distinct), [0]])
    return np.insert(codes, starts[1:], len(distinct)), starts + np.arange(len(starts)), hashes, shapes


def summed(keys: np.ndarray, shapes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return found, shapes[first], np.bincount(inverse, weights=counts, minlength=len(found)).astype(np.int64)


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        keys, shapes, counts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(shapes.astype(np.int32)), pa.array(counts)], names=["h", "shape", "c"])

    for batch in batches:
        for part in words.slices(batch, "text", 8 << 20):
            codes, _, hashes, shapes = split(part.column("text"))
            held.append((hashes, shapes, np.bincount(codes, minlength=len(hashes))))
            if sum(len(x[0]) for x in held) > 2_000_000:
                yield out()
    if held:
        yield out()


@dataclass
class Vocabulary:
    """What every task needs to know of the counts; arrays of bounded size."""

    total: int
    types: int
    slots: int  # of each class
    parts: int  # classes of each tail shape
    buckets: int
    known: np.ndarray  # sorted hashes of the most frequent tokens, their counts and ranks
    known_counts: np.ndarray
    known_ranks: np.ndarray
    hot: np.ndarray  # counts of the most frequent tokens by rank, as far as they fill half a bucket
    mass: np.ndarray  # class x slot: tokens, and in tail slots types + 1

    @property
    def classes(self) -> int:
        return self.slots + SHAPES * self.parts

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (-1) and ranks (the number of known tokens) of tokens; in brackets those of others."""
        if not len(self.known):
            return np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        own = self.known[at] == hashes
        return np.where(own, self.known_counts[at], -1), np.where(own, self.known_ranks[at], len(self.known))

    def outcomes(self, hashes: np.ndarray, shapes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """class * slots + slot."""
        b, d = np.uint64(self.slots), np.uint64(self.parts)
        tail = self.slots + shapes * self.parts + ((hashes >> np.uint64(8)) % d).astype(np.int64)
        tail = tail * self.slots + ((hashes >> np.uint64(20)) % b).astype(np.int64)
        return np.where(ranks < min(len(self.known), self.slots**2), ranks, tail)

    def histories(self, hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        return np.where(ranks < len(self.known), ranks, (1 << 20) + (hashes >> np.uint64(41)).astype(np.int64))

    def dealt(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, texts: int, model: Model) -> np.ndarray:
        """The bucket of each token, from the tokens before it and its document's hash."""
        if self.buckets == 1:
            return np.zeros(len(h1), np.int64)

        def weight(h: np.ndarray) -> np.ndarray:
            own = self.hot[np.minimum(h, len(self.hot) - 1)] if len(self.hot) else np.zeros(len(h), np.int64)
            return np.where(h == START, texts, np.where(h < len(self.hot), own, 0))

        first, second = weight(h1), weight(h2)
        half = model.bucket_tokens // 2
        value = words.mixed(h1.astype(np.uint64))
        heavy = first > half
        value[heavy] = words.mixed(value[heavy] ^ h2[heavy].astype(np.uint64))
        both = np.flatnonzero(heavy & (second > half))
        ways = np.minimum(first[both], second[both]) // half + 1
        value[both] = words.mixed(value[both] ^ (doc[both] % ways.astype(np.uint64)))
        return (value % np.uint64(self.buckets)).astype(np.int64)


def vocabulary(counts: DataFrame, model: Model) -> Vocabulary:
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, types = int(whole["n"] or 0), int(whole["v"])
    least = max(1, -(-total // model.known))  # at most ``known`` tokens can be that frequent
    top = counts.where(F.col("c") >= least).toArrow()
    hashes, c, shapes = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy(), top.column("shape").to_numpy().astype(np.int64)
    rank = np.lexsort((hashes, -c))
    hashes, c, shapes = hashes[rank], c[rank], shapes[rank]
    slots = max(4, min(model.most_slots, round(model.breadth * types**0.25)))
    parts = max(1, round(slots / 64))
    part, slot = F.shiftrightunsigned("h", 8) % parts, F.shiftrightunsigned("h", 20) % slots
    tail = counts.groupBy("shape", part.alias("part"), slot.alias("slot")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # slots, not types
    mass = np.ones((slots + SHAPES * parts, slots))
    for r in tail:
        mass[slots + r["shape"] * parts + r["part"], r["slot"]] += r["c"] + r["v"]
    own = min(len(c), slots * slots)
    mass[:slots] = np.concatenate([c[:own], np.zeros(slots * slots - own)]).reshape(slots, slots)
    at = slots + shapes[:own] * parts + ((hashes[:own] >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)
    np.subtract.at(mass, (at, ((hashes[:own] >> np.uint64(20)) % np.uint64(slots)).astype(np.int64)), c[:own] + 1)
    buckets = min(model.most_buckets, max(1, -(-total * model.modulus // ((model.modulus - 1) * model.bucket_tokens))))
    order = np.argsort(hashes)
    return Vocabulary(total, types, slots, parts, buckets, hashes[order], c[order], np.arange(len(c))[order], c[: int((c > max(model.bucket_tokens // 2, total >> 16)).sum())], mass)


def squeezed(values: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, compressed."""
    size = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T).tobytes())


def loosened(raw: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def firsts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def runs(begin: np.ndarray, size: int) -> np.ndarray:
    """The number of its run for each of ``size`` values."""
    return np.repeat(np.arange(len(begin)), np.diff(np.append(begin, size)))


def bucket_scores(keys: np.ndarray, learn: np.ndarray, seen: Vocabulary, model: Model) -> np.ndarray:
    """Fit a bucket on the tokens marked in ``learn`` and return the log10 probability of every token's slot.

    ``keys``: token before << 40 | the one before that << 16 | outcome.
    """
    slots, classes = seen.slots, seen.classes
    prior = (seen.mass.sum(axis=1) / seen.mass.sum()).astype(np.float32)
    within = (seen.mass / np.maximum(seen.mass.sum(axis=1, keepdims=True), 1e-9)).astype(np.float32)
    order = np.argsort(keys)
    ordered = keys[order]
    begin = firsts(ordered)
    tuples, times = ordered[begin], np.add.reduceat(learn[order].astype(np.float32), begin)
    outcome = (tuples & np.uint64(0xFFFF)).astype(np.int64)
    kind, slot = outcome // slots, outcome % slots
    # tuples form groups of one history and class, groups form histories, histories form runs of one token before
    group = firsts((tuples >> np.uint64(16)) * np.uint64(classes) + kind.astype(np.uint64))
    group_of, group_kind, group_times = runs(group, len(tuples)), kind[group], np.add.reduceat(times, group)
    history = firsts(tuples[group] >> np.uint64(16))
    history_of, history_times = runs(history, len(group)), np.add.reduceat(group_times, history)
    pair = tuples[group[history]] >> np.uint64(16)
    row = firsts(pair >> np.uint64(24))
    row_of = runs(row, len(history))
    group_end, history_end, row_end = np.append(group, len(tuples)), np.append(history, len(group)), np.append(row, len(history))
    # skip rows: the token before the last, where it has training tokens enough
    two, skip_of = np.unique(pair & np.uint64(0xFFFFFF), return_inverse=True)
    often = np.bincount(skip_of, weights=history_times, minlength=len(two)) >= model.skip_tokens
    skip_of = np.where(often[skip_of], np.cumsum(often)[skip_of], 0)

    def blocks() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of histories with whole rows of the token before: bounds, and the rows' counts and weights (as factors)."""
        a = 0
        while a < len(row):
            z = max(a + 1, int(np.searchsorted(row_end, row_end[a] + model.batch, side="right")) - 1)
            g, h = slice(history_end[row_end[a]], history_end[row_end[z]]), slice(row_end[a], row_end[z])
            at = (row_of[history_of[g]] - a) * classes + group_kind[g]
            counts = np.bincount(at, weights=group_times[g], minlength=(z - a) * classes).reshape(-1, classes).astype(np.float32)
            expected = np.add.reduceat(history_times[h], row_end[a:z] - row_end[a])[:, None] * prior
            yield a, z, (counts + model.before) / (expected + model.before) * prior
            a = z

    def batches(a: int, z: int) -> Iterator[tuple[slice, slice]]:
        for i in range(row_end[a], row_end[z], model.batch):
            j = min(i + model.batch, row_end[z])
            yield slice(i, j), slice(history_end[i], history_end[j])

    def observed(h: slice, g: slice) -> np.ndarray:
        out = np.zeros((h.stop - h.start, classes), np.float32)
        out[history_of[g] - h.start, group_kind[g]] = group_times[g]
        return out

    expected = np.zeros((int(often.sum()) + 1, classes), np.float32)
    counted = np.zeros_like(expected)
    for a, z, rows in blocks():
        for h, g in batches(a, z):
            p = rows.take(row_of[h] - a, axis=0)
            p *= (history_times[h] / p.sum(axis=1))[:, None]
            by = np.argsort(skip_of[h], kind="stable")
            at = firsts(skip_of[h][by])
            to = skip_of[h][by][at]
            expected[to] += np.add.reduceat(p[by], at, axis=0)
            counted[to] += np.add.reduceat(observed(h, g)[by], at, axis=0)
    skips = (counted + model.skip) / (expected + model.skip)
    skips[0] = 1

    log = np.empty(len(tuples))
    for a, z, rows in blocks():
        g = slice(history_end[row_end[a]], history_end[row_end[z]])
        t = slice(group_end[g.start], group_end[g.stop])
        # slots: rows of the token before and the class
        own = (row_of[history_of[g]] - a) * classes + group_kind[g]
        used, own = np.unique(own, return_inverse=True)
        counts = np.bincount(own[group_of[t] - g.start] * slots + slot[t], weights=times[t], minlength=len(used) * slots).reshape(-1, slots).astype(np.float32)
        shares = within[used % classes]
        inner = shares * (counts + model.before) / (counts.sum(axis=1, keepdims=True) * shares + model.before)
        inner /= inner.sum(axis=1, keepdims=True)
        for h, gg in batches(a, z):
            p = rows.take(row_of[h] - a, axis=0)
            p *= skips.take(skip_of[h], axis=0)
            p /= p.sum(axis=1, keepdims=True)
            e = p * history_times[h][:, None]
            p *= (observed(h, gg) + model.pair) / (e + model.pair)
            p /= p.sum(axis=1, keepdims=True)
            outer = np.log10(p[history_of[gg] - h.start, group_kind[gg]])
            for i in range(gg.start, gg.stop, model.batch):
                j = min(i + model.batch, gg.stop)
                tt = slice(group_end[i], group_end[j])
                q = inner.take(own[i - g.start : j - g.start], axis=0)
                e = q * group_times[i:j][:, None]
                c = np.zeros_like(q)
                c[group_of[tt] - i, slot[tt]] = times[tt]
                q *= (c + model.pair) / (e + model.pair)
                q /= q.sum(axis=1, keepdims=True)
                log[tt] = outer[group_of[tt] - gg.start] + np.log10(q[group_of[tt] - i, slot[tt]])
    out = np.empty(len(keys))
    out[order] = np.repeat(log, np.diff(np.append(begin, len(keys))))
    return out


SENT = "bucket int, slice bigint, tokens bigint, keys binary, docs binary"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, rare array<bigint>, times array<int>"


def sent(seen: Vocabulary, model: Model, texts: int):
    """Per slice of texts a row of what is known of its documents (no tokens), and a row of tokens for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_id = TaskContext.get().partitionId() << 24
        space = np.log10(seen.total + seen.types + 1)
        for batch in batches:
            for part in words.slices(batch, "text", 4 << 20):
                codes, starts, hashes, shapes = split(part.column("text"))
                n, owners = part.num_rows, words.owner(starts)
                counts, ranks = seen.found(hashes)
                outcome = seen.outcomes(hashes, shapes, ranks)
                known = np.log10(np.maximum(counts, 0) + 1.0)
                tail = outcome >= seen.slots**2
                share = np.where(tail, known - np.log10(np.maximum(1, seen.mass.ravel()[outcome])), 0.0)
                rare = np.flatnonzero(counts[codes] < 0)
                pairs, times = np.unique(owners[rare] * len(hashes) + codes[rare], return_counts=True)
                whose, which = pairs // len(hashes), pairs % len(hashes)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=n))]).astype(np.int32))
                base = np.bincount(owners, known[codes] - space, n)
                about = pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("held_out"), pa.array(np.diff(starts)), pa.array(np.bincount(owners, counts[codes] > 0, n).astype(np.int64)),
                        pa.array(base), pa.array(np.bincount(owners, share[codes], n) if seen.total else base),
                        pa.ListArray.from_arrays(offsets, pa.array(hashes[which].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
                    ],
                    names=[c.split()[0] for c in SCORES.split(", ")],
                )
                rows = [(slice_id % seen.buckets, 0, b"", table_bytes(about))]
                if seen.total:
                    token = seen.histories(hashes, ranks)[codes]
                    place = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
                    h1, h2 = np.full(len(codes), START), np.full(len(codes), START)
                    h1[1:], h2[2:] = token[:-1], token[:-2]
                    h1[place < 1], h2[place < 2] = START, START
                    bucket = seen.dealt(h1, h2, part.column("key").to_numpy().view(np.uint64)[owners], texts, model).astype(np.uint16)
                    keys = (h1.astype(np.uint64) << np.uint64(40)) | (h2.astype(np.uint64) << np.uint64(16)) | outcome[codes].astype(np.uint64)
                    marked = (owners * 2 + part.column("held_out").to_numpy(zero_copy_only=False)[owners]).astype(np.uint32)
                    order = np.argsort(bucket, kind="stable")
                    bucket, keys, marked = bucket[order], keys[order], marked[order]
                    begin = firsts(bucket)
                    for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(bucket)], strict=True):
                        rows.append((int(bucket[i]), j - i, squeezed(keys[i:j]), squeezed(np.diff(marked[i:j], prepend=np.uint32(0)))))
                b, size, k, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b, pa.int32()), pa.array([slice_id] * len(b), pa.int64()), pa.array(size, pa.int64()), pa.array(k, pa.binary()), pa.array(d, pa.binary())],
                    names=["bucket", "slice", "tokens", "keys", "docs"],
                )
                slice_id += 1

    return run


def table_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def fitted(seen: Vocabulary, model: Model):
    """Rows of SENT sorted by bucket -> (slice, docs, sums): what is known of documents as it came, and sums of documents' scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in store.sorted_runs(batches, ["bucket"], "tokens", model.held_tokens):
            size = group.column("tokens").to_numpy()
            about = group.filter(pa.array(size == 0))
            if about.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [about.column("slice").combine_chunks(), about.column("docs").combine_chunks(), pa.array([None] * about.num_rows, pa.binary())], names=["slice", "docs", "sums"]
                )
            group, size = group.filter(pa.array(size > 0)), size[size > 0]
            if not len(size):
                continue
            keys = np.concatenate([loosened(x, np.uint64) for x in group.column("keys").to_pylist()])
            marked = [np.cumsum(loosened(x, np.uint32), dtype=np.int64) for x in group.column("docs").to_pylist()]
            log = bucket_scores(keys, np.concatenate(marked) & 1 == 0, seen, model)
            docs, sums, at = [], [], 0
            for m in marked:
                begin = firsts(m)
                docs.append(squeezed((m[begin] >> 1).astype(np.uint32)))
                sums.append(squeezed(np.add.reduceat(log[at : at + len(m)], begin).astype(np.float32)))
                at += len(m)
            yield pa.RecordBatch.from_arrays([group.column("slice").combine_chunks(), pa.array(docs, pa.binary()), pa.array(sums, pa.binary())], names=["slice", "docs", "sums"])

    return run


def added_up(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """All rows of a slice -> its documents (SCORES)."""
    about, total = None, []
    for docs, sums in zip(group.column("docs").to_pylist(), group.column("sums").to_pylist(), strict=True):
        if sums is None:
            about = pa.ipc.open_stream(docs).read_all().combine_chunks().to_batches()[0]
        else:
            total.append((loosened(docs, np.uint32), loosened(sums, np.float32).astype(np.float64)))
    if total:
        docs, sums = (np.concatenate(x) for x in zip(*total, strict=True))
        value = about.column("score").to_numpy() + np.bincount(docs, sums, about.num_rows)
        about = about.set_column(about.schema.get_field_index("score"), "score", pa.array(value))
    yield about


def scored(docs: DataFrame, model: Model = Model()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, train_types: one row per row of ``docs``."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        store.held_out("doc_id", model.modulus, model.remainder).alias("held_out"), F.xxhash64("doc_id", "text").alias("key"),
    )
    learning = rows.where(~F.col("held_out"))
    counts = learning.select("text").mapInArrow(count_tokens, "h bigint, shape int, c bigint").groupBy("h").agg(F.min("shape").alias("shape"), F.sum("c").alias("c"))
    counts = store.written(counts, "lm-counts")
    seen = vocabulary(counts, model)
    end = counts.where(F.col("h") == int(END.view(np.int64))).agg(F.sum("c")).first()[0] or 0  # one for each training text
    dealt = rows.mapInArrow(sent(seen, model, int(end)), SENT).repartition("bucket").sortWithinPartitions("bucket", "slice")
    bare = replace(seen, known=seen.known[:0], known_counts=seen.known_counts[:0], known_ranks=seen.known_ranks[:0])
    sums = dealt.mapInArrow(fitted(bare, model), "slice bigint, docs binary, sums binary")
    first = store.written(store.per_run(sums, ["slice"], added_up, SCORES).withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    rare = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("t"))
    added = (
        rare.join(counts.select("h", "c"), "h")
        .groupBy("row").agg(F.sum(F.col("t") * F.log10(F.col("c") + 1)).alias("more"), F.sum(F.col("t").cast("bigint")).alias("of_them"))
    )
    more, of_them = F.coalesce("more", F.lit(0.0)), F.coalesce("of_them", F.lit(0))
    return first.join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + of_them).alias("n_known"), F.lit(seen.total).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"), F.lit(seen.types).cast("bigint").alias("train_types"),
    )


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(store.table(spark, sf_dir, "documents"))
