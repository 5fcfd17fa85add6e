"""Operator 5, packing: concatenate all documents' tokens and cut the stream into fixed windows.

Pass one tokenises each partition, numbers its tokens and writes ids with their place in the partition; one row per
partition then carries its token total. Pass two adds the prefix sum of those totals, which makes places global, and
cuts each document at the window bounds. Every piece is a boundary record: which document's tokens stand where in which
sequence. Only the last sequence can be short; it is padded to the window unless its length is a power of two
(``padded_length``). The written table of pass one fixes the order, so a retried task gives the same pieces.

White space separates words for this tokenizer, so the ids of a text are those of its space-separated chunks in a row;
each task keeps the ids of the pieces of chunks it met last (at most twice ``cache`` and what one slice adds).

Defined cases: null and empty texts hold only the closing id; repeated rows and equal ids are packed each; a null id
stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaprobe.llm import store, words


@dataclass(frozen=True)
class Pack:
    tokenizer: str = "word_bpe_49k.json"
    window: int = 2048
    closing_id: int = 1
    cache: int = 300_000


PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "opens boolean, closes boolean, padded_length bigint"
)


PUNCTUATION = r"[!-&(-/:;=>?@\[-`{-~]+$"  # without the apostrophe and <, which can belong to longer tokens


class Chunks:
    """ids of space-separated chunks. Letters and the signs after them are looked up apart, since the tokenizer never joins
    them; new ones are encoded many at a time, as one text, and told apart by the marks of word ends."""

    def __init__(self, pack: Pack):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(public_tokenizers.path(pack.tokenizer)), pack.cache
        self.known: dict[str, bytes] = {"": b""}  # little-endian unsigned 32-bit ids
        self.before: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def learn(self, pieces: list[str], single: list[str]) -> None:
        """``pieces``: runs of letters or of signs, one word each for the tokenizer; ``single``: anything else."""
        if len(self.known) > self.most:
            self.before, self.known = self.known, {"": b""}
        fresh = []
        for x in pieces:
            if x not in self.known:
                old = self.before.get(x)
                if old is None:
                    fresh.append(x)
                else:
                    self.known[x] = old
        for a in range(0, len(fresh), 2000):
            own = fresh[a : a + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(own), add_special_tokens=False).ids, "<u4")
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(stops) == len(own) and stops[-1] == 4 * len(ids):
                raw = ids.tobytes()
                self.known.update(zip(own, [raw[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)], strict=True))
            else:
                single = [*single, *own]
        single = [x for x in single if x not in self.known]
        for x, e in zip(single, self.tokenizer.encode_batch_fast(single, add_special_tokens=False), strict=True):
            self.known[x] = np.array(e.ids, "<u4").tobytes()

    def ids(self, distinct: pa.Array) -> list[bytes]:
        """ids of each chunk."""
        stems = pc.replace_substring_regex(distinct, PUNCTUATION, "")
        plain = pc.or_(pc.match_substring_regex(stems, r"^\pL+$"), pc.equal(pc.binary_length(stems), 0))
        heads = pc.if_else(plain, stems, distinct)
        signed = pc.greater(pc.binary_length(distinct), pc.binary_length(heads)).to_numpy(zero_copy_only=False)
        first, whole = words.listed(heads), words.listed(distinct)
        tails = dict.fromkeys(np.flatnonzero(signed).tolist())
        for i in tails:
            tails[i] = whole[i][len(first[i]) :]
        self.learn([*words.listed(pc.unique(heads.filter(plain))), *set(tails.values())], words.listed(heads.filter(pc.invert(plain))))
        known = self.known
        out = [known[h] for h in first]
        for i, t in tails.items():
            out[i] += known[t]
        return out


def token_rows(pack: Pack):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, place, part_id = Chunks(pack), 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in words.slices(batch, "text", 2 << 20):
                # the tokenizer lower-cases; doing so before merges more chunks, but could make a special token of other text
                special = pc.any(pc.match_substring(part.column("text"), "<|")).as_py()
                codes, starts, distinct = words.split(part.column("text"), lower=not special)
                ids = chunks.ids(distinct)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                table = np.frombuffer(b"".join(ids), "<u4")
                begins = np.cumsum(sizes) - sizes
                # lay the chunks' ids out in text order, with room for each text's closing id
                length = sizes[codes] if len(codes) else np.empty(0, np.int64)
                total = np.concatenate([[0], np.cumsum(length)])
                flat = np.arange(total[-1]) - np.repeat(total[:-1], length)
                flat = table[flat + np.repeat(begins[codes] if len(codes) else length, length)]
                ends = total[starts[1:]]
                flat = np.insert(flat, ends, pack.closing_id).astype("<u4")
                counts = ends - total[starts[:-1]] + 1
                bounds = np.concatenate([[0], np.cumsum(counts)])
                small = flat.astype("<u2") if flat.max(initial=0) < 1 << 16 else flat
                raw = [small[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(part.num_rows, part_id, np.int32)), part.column("doc_id"), pa.array(place + bounds[:-1]), pa.array(counts), pa.array(raw, pa.binary())],
                    names=["part", "doc_id", "place", "tokens", "ids"],
                )
                place += int(bounds[-1])

    return run


def pieces(pack: Pack, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "ids"):
                rows = {k: [] for k in ("row", "start", "length", "crc")}
                tokens, place = part.column("tokens").to_numpy(), part.column("place").to_numpy() + part.column("before").to_numpy()
                for i, raw in enumerate(words.listed(part.column("ids"))):
                    n, at = int(tokens[i]), int(place[i])
                    ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                    cuts = [0, *range(pack.window - at % pack.window, n, pack.window), n]
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        rows["row"].append(i)
                        rows["start"].append(a)
                        rows["length"].append(b - a)
                        rows["crc"].append(zlib.crc32(ids[a:b].tobytes()))
                row, start, length = (np.array(rows[k], np.int64) for k in ("row", "start", "length"))
                where = place[row] + start
                sequence, offset = where // pack.window, where % pack.window
                own = np.minimum(pack.window, total - sequence * pack.window)
                padded = np.where(own & (own - 1), pack.window, own)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(rows["crc"], pa.int64()), pa.array(tokens[row]),
                        pa.array(sequence), pa.array(offset), pa.array(start == 0), pa.array(start + length == tokens[row]), pa.array(padded),
                    ],
                    names=[c.split()[0] for c in PIECES.split(", ")],
                )

    return run


def packed(docs: DataFrame, pack: Pack = Pack()) -> DataFrame:
    """One row per piece (PIECES); pieces of a sequence stand at gapless offsets."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tokens = store.written(rows.mapInArrow(token_rows(pack), "part int, doc_id bigint, place bigint, tokens bigint, ids binary"), "pack-tokens")
    totals = sorted((r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("tokens").alias("n")).collect())  # one row per partition
    before, total = [], 0
    for part, n in totals:
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "part int, before bigint")
    return tokens.join(F.broadcast(offsets), "part").mapInArrow(pieces(pack, total), PIECES)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(store.table(spark, sf_dir, "documents"))
