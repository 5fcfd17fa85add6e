"""Words of whole texts as integer codes: Arrow splits and encodes a slice of a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20  # a slice's codes, hashes and windows take about 25 times its text, and a worker keeps its peak over all later stages
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every output bit depends on every input bit."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``most_bytes`` of the column, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def split(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: codes of all words, where each text's words start, the distinct words.

    A null text has no words. ``lower`` lower-cases A-Z only.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0)
    seen = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy()
    starts = seen[offsets - offsets[0]].astype(np.int64)
    coded = flat.filter(full).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts, coded.dictionary


def listed(values: pa.Array) -> list:
    """Python objects of a string or binary array, made by Arrow in one go."""
    return values.to_numpy(zero_copy_only=False).tolist()


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A stable 64-bit hash of each word."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in listed(words.cast(pa.binary()))), np.uint64, len(words))


def owner(starts: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def windows(values: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words that stays inside its text, and the index of its first word."""
    if len(values) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(len(values) - n + 1, np.uint64)
    for k in range(n):
        total = mixed(total ^ values[k : len(values) - n + 1 + k])
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(values))
    at = np.flatnonzero(left[: len(total)] >= n)
    return total[at], at
