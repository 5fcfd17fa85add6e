"""Operator 6, quality rules: per-document counts, and lines that many documents of a host share.

Method (cross-document line frequency): every line is normalised (white space runs to one space, trimmed,
A-Z lower-cased) and hashed; for each host the documents that carry the line are counted; lines above the limit
are removed; a document that loses too much is rejected as depleted.

What counts as a distinct document: copies say nothing about boilerplate. A line is a document's own if no more than
``line_documents`` rows of the host carry it. Documents count by a hash of their own lines, which exact copies share and pages of one
template don't, however short these lines are; a document without own lines counts by a hash of all its lines. An own line that agrees
with a shared line of the host is an altered form of it: they have one of their anchors in common, the ``anchors`` first of a line's
runs of ``anchor_words`` words in code-point order. Altered forms, and own lines of fewer words, say nothing of their own; a document
whose own lines are all such is a near copy and counts by the rarest of its shared lines, the first of equally rare ones, so a
cluster of near copies counts about once. Lines under ``min_line_words`` words count as well, with limits ``short_factor`` times as high.

Defined cases: a null or empty text has no words and fails the base rule; a null host is a host of its own, a null id one like others;
repeated rows get the same verdict each; a very long text is one row of its task, its lines a row each afterwards; an empty table gives
an empty result; columns beside the ones named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaprobe.llm import store, words


@dataclass(frozen=True)
class Limits:
    min_words: int = 10
    repeat_percent: int = 20
    min_line_words: int = 5
    line_documents: int = 20
    line_percent: float = 0.1
    depleted_percent: int = 80
    short_factor: int = 5
    anchor_words: int = 4
    anchors: int = 6


STATS = (
    "doc_id bigint, host string, text_key bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, all_lines bigint, line_hash array<bigint>, line_size array<int>, line_words array<int>, line_anchors array<array<bigint>>"
)


def _anchors(codes: np.ndarray, starts: np.ndarray, distinct: pa.Array, value: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Of all lines, in order: hashes of each line's first distinct runs of words in code-point order, and the line of each hash."""
    at, where = words.windows(value, starts, limits.anchor_words)
    line = words.owner(starts)[where]
    rank = np.empty(len(distinct), np.int64)
    rank[pc.sort_indices(distinct).to_numpy()] = np.arange(len(distinct))
    order = np.lexsort([*(rank[codes[where + k]] for k in range(limits.anchor_words - 1, -1, -1)), line])
    at, line = at[order], line[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (line[1:] != line[:-1])
    at, line = at[new], line[new]
    first = np.arange(len(at)) - np.searchsorted(line, line) < limits.anchors
    return at[first], line[first]


def _lines(texts: pa.Array, limits: Limits | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple | None]:
    """Of all texts' \\n-split lines that hold a word: owner, hash of the line as it stands, hash when normalised, words; with
    ``limits`` also the anchors and how many each line has."""
    lists = pc.split_pattern(texts, "\n")
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy()
    owners = np.repeat(np.arange(len(texts)), np.diff(offsets))
    codes, starts, distinct = words.split(flat, lower=True)
    counts = np.diff(starts)
    full = np.flatnonzero(counts)
    if not len(full):
        none = np.empty(0, np.uint64)
        return owners[full], none, none, counts[full], limits and (none, counts[full])
    line_hash = np.zeros(len(flat), np.uint64)
    # a line's hash is a position-weighted sum of its words' hashes, so it is one segmented sum
    plain = words.word_hashes(distinct)[codes]
    place = np.arange(len(codes)) - np.repeat(starts[:-1], counts)
    value = words.mixed(plain + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    line_hash[full] = np.add.reduceat(value, starts[:-1][full])
    raw = flat.take(pa.array(full)).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    anchors = None
    if limits:
        at, line = _anchors(codes, starts, distinct, plain, limits)
        anchors = at, np.bincount(line, minlength=len(flat))[full]
    return owners[full], raw.astype(np.uint64), words.mixed(line_hash[full]), counts[full], anchors


def _first_seen(owners: np.ndarray, values: np.ndarray) -> np.ndarray:
    """True for the first row of each (owner, value)."""
    order = np.lexsort((np.arange(len(values)), values, owners))
    same = np.zeros(len(values), bool)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        same[b] = (owners[a] == owners[b]) & (values[a] == values[b])
    return ~same


def statistics(batches: Iterator[pa.RecordBatch], limits: Limits = Limits()) -> Iterator[pa.RecordBatch]:
    """doc_id, host, text_key, text -> STATS, a slice of whole texts at a time."""
    for batch in batches:
        for part in words.slices(batch, "text"):
            n = part.num_rows
            texts = pc.fill_null(part.column("text"), "")
            codes, starts, distinct = words.split(texts)
            counts = np.diff(starts)
            chars = np.concatenate([[0], np.cumsum(pc.utf8_length(distinct).to_numpy(zero_copy_only=False)[codes])])
            at, where = words.windows(codes.astype(np.uint64), starts, 5)
            owners = words.owner(starts)
            twice = np.zeros(len(at), bool)
            if len(at):
                order = np.lexsort((at, owners[where]))
                a, b = order[:-1], order[1:]
                same = (owners[where[a]] == owners[where[b]]) & (at[a] == at[b])
                twice[a[same]] = True
                twice[b[same]] = True
            covered = np.zeros(len(codes) + 1, np.int64)
            np.add.at(covered, where[twice], 1)
            np.add.at(covered, where[twice] + 5, -1)
            repeated = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
            line_owner, raw, line_hash, line_words, (anchors, per_line) = _lines(texts, limits)
            duplicate = ~_first_seen(line_owner, raw)
            fresh = _first_seen(line_owner, line_hash)
            counted = np.bincount(line_owner[fresh], minlength=n)
            ends = np.cumsum(counted)
            kept_hash = line_hash[fresh].view(np.int64)
            all_lines = np.zeros(n, np.int64)
            some = np.flatnonzero(counted)
            if len(some):
                all_lines[some] = np.bitwise_xor.reduceat(kept_hash, (ends - counted)[some])
            # a repeated line is removed wherever it stands: its words count as often as it occurs
            both = np.zeros(len(line_hash), np.int64)
            order = np.lexsort((~fresh, line_hash, line_owner))
            first = np.flatnonzero(fresh[order])
            if len(order):
                both[order[first]] = np.add.reduceat(line_words[order], first)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            kept_anchors = anchors[np.repeat(fresh, per_line)].view(np.int64)
            anchor_ends = pa.array(np.concatenate([[0], np.cumsum(per_line[fresh])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("host"),
                    part.column("text_key"),
                    pa.array(counts),
                    pa.array(chars[starts[1:]] - chars[starts[:-1]]),
                    pc.cast(pc.count_substring_regex(texts, r"[#*$%&|<>]"), pa.int64()),
                    pa.array(np.bincount(line_owner[duplicate], minlength=n)),
                    pa.array(repeated[starts[1:]] - repeated[starts[:-1]]),
                    pa.array(all_lines),
                    pa.ListArray.from_arrays(offsets, pa.array(kept_hash)),
                    pa.ListArray.from_arrays(offsets, pa.array(line_words[fresh].astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(both[fresh].astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.ListArray.from_arrays(anchor_ends, pa.array(kept_anchors))),
                ],
                names=[c.split()[0] for c in STATS.split(", ")],
            )


def prepared(docs: DataFrame, host: str = "source") -> DataFrame:
    """The columns that the operator reads, under its own names."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col(host).cast("string").alias("host"),
        F.xxhash64("doc_id", host, "text").alias("text_key"), F.col("text"),
    )


def in_host(value: str) -> Column:
    """A key of a value within its host; a null host is a host of its own."""
    return F.xxhash64(F.coalesce("host", F.lit("")), F.col("host").isNull(), value)


def counted(stats: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """Of lines that more than ``line_documents`` rows of a host carry: (text_key, key, line, n words) for each text with such a line, and
    (key, host, size, rows, documents), the distinct documents that carry it."""
    lines = stats.select(
        "text_key", "host", "all_lines", F.size("line_hash").alias("all"), F.posexplode(F.arrays_zip("line_hash", "line_size", "line_words", "line_anchors")).alias("place", "x")
    ).select(
        "text_key", "host", "all_lines", "all", "place", F.col("x.line_hash").alias("line"), F.col("x.line_size").alias("size"), F.col("x.line_words").alias("n"),
        F.col("x.line_anchors").alias("anchors"), in_host("x.line_hash").alias("key"),
    )
    shared = lines.groupBy("key").agg(F.count("*").alias("rows"), F.first("anchors").alias("anchors"), F.first("host").alias("host"), F.min("size").alias("size"))
    shared = store.written(shared.where(F.col("rows") > limits.line_documents), "quality-shared")
    total = stats.agg(F.sum(F.size("line_hash"))).first()[0] or 0
    marked = store.joined_by_share(lines, shared.select("key", "rows", F.col("rows").alias("n")), ["key"], total, F.xxhash64("text_key"), "left")
    # sets, as repeated rows bring a line again; one row per text, its lines' hashes beside it
    carriers = marked.groupBy("text_key").agg(
        F.first("host").alias("host"), F.first("all_lines").alias("all_lines"), F.first("all").alias("all"),
        F.collect_set(F.when(F.col("rows").isNotNull(), F.struct("rows", "place", "line", "n", "key"))).alias("shared"),
        F.collect_set(F.when(F.col("rows").isNull() & (F.size("anchors") > 0), F.struct("line", "anchors"))).alias("own"),
    ).where(F.size("shared") > 0)
    carriers = store.written(carriers, "quality-carriers")
    anchors = carriers.select("text_key", "host", F.explode("own").alias("x")).select("text_key", "host", "x.line", F.explode("x.anchors").alias("anchor"))
    anchors = anchors.select("text_key", "line", in_host("anchor").alias("at"))
    known = shared.select("host", F.explode("anchors").alias("anchor")).select(in_host("anchor").alias("at")).distinct()
    known = store.written(anchors.groupBy("at").agg(F.count("*").alias("n")).join(known, "at", "left_semi"), "quality-anchors")
    hits = store.joined_by_share(anchors, known, ["at"], total * limits.anchors, F.xxhash64("text_key"))
    altered = hits.groupBy("text_key").agg(F.collect_set("line").alias("altered"))
    kinds = carriers.join(altered, "text_key", "left").withColumn("altered", F.coalesce("altered", F.array().cast("array<bigint>")))
    of_lines = F.aggregate("own", F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x["line"]))
    of_lines = F.aggregate("altered", of_lines, lambda a, x: a.bitwiseXOR(x))
    copy, near = F.col("all") == F.size("shared"), F.size("own") == F.size("altered")
    kind = F.when(copy, F.col("all_lines")).when(near, F.array_min("shared")["line"]).otherwise(of_lines)
    way = F.when(copy, 0).when(near, 1).otherwise(2)
    kinds = kinds.select("text_key", way.alias("way"), kind.alias("kind"), F.explode("shared").alias("x")).select("text_key", "way", "kind", "x.key", "x.line", "x.n")
    kinds = store.written(kinds, "quality-carried")
    # (line, kind) is made distinct first, so a hot line is summed from many tasks' partial counts
    seen = kinds.select("key", "way", "kind").distinct().groupBy("key").agg(F.count("*").alias("documents"))
    return kinds.select("text_key", "key", "line", "n"), shared.drop("anchors").join(seen, "key")


def judged(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """One row per row of ``docs``: STATS without the line arrays, plus base_failed, removed_words, removed (hashes), kept."""
    stats = store.written(prepared(docs, host).mapInArrow(lambda batches: statistics(batches, limits), STATS), "quality-stats")
    carried, seen = counted(stats, limits)
    sizes = stats.groupBy(F.col("host").alias("of_host")).agg(F.count("*").alias("host_documents"))
    factor = F.when(F.col("size") < limits.min_line_words, limits.short_factor).otherwise(1)
    frequent = seen.where(F.col("documents") > factor * limits.line_documents).join(sizes, F.col("host").eqNullSafe(F.col("of_host")))
    frequent = frequent.where(F.col("documents") > factor * F.col("host_documents") * limits.line_percent / 100)
    frequent = store.written(frequent.select("key", F.col("rows").alias("n")), "quality-lines")
    total = frequent.agg(F.sum("n")).first()[0] or 0
    lost = store.joined_by_share(carried.withColumnRenamed("n", "of_line"), frequent, ["key"], total, F.xxhash64("text_key"))
    lost = lost.groupBy("text_key").agg(F.sum("of_line").alias("removed_words"), F.collect_set("line").alias("removed"))
    out = stats.drop("line_hash", "line_size", "line_words", "line_anchors", "all_lines").join(lost, "text_key", "left")
    base_failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    removed = F.coalesce("removed_words", F.lit(0)).cast("bigint")
    depleted = (100 * removed > limits.depleted_percent * F.col("n_words")) | ((removed > 0) & (F.col("n_words") - removed < limits.min_words))
    return out.withColumns({"base_failed": base_failed, "removed_words": removed, "kept": ~base_failed & ~depleted})


def without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop from each text the lines whose normalised hash is in ``removed``; other lines stay as they are."""
    for batch in batches:
        for part in words.slices(batch, "text"):
            removed = part.column("__removed")
            touched = np.flatnonzero(pc.fill_null(pc.list_value_length(removed), 0).to_numpy(zero_copy_only=False))
            texts = part.column("text")
            if len(touched):
                new = texts.to_pylist()
                own = texts.take(pa.array(touched))
                lists = pc.split_pattern(own, "\n")
                owners, _, hashes, _, _ = _lines(own)
                place = np.flatnonzero(np.diff(words.split(lists.flatten(), lower=True)[1]))
                flat, offsets = lists.flatten().to_pylist(), lists.offsets.to_numpy()
                by_line = dict(zip(place.tolist(), hashes.view(np.int64).tolist(), strict=True))
                for k, row in enumerate(touched.tolist()):
                    gone = set(removed[row].as_py())
                    a, b = offsets[k] - offsets[0], offsets[k + 1] - offsets[0]
                    new[row] = "\n".join(flat[i] for i in range(a, b) if by_line.get(i) not in gone)
                texts = pa.array(new, texts.type)
            yield part.set_column(part.schema.get_field_index("text"), "text", texts).drop_columns(["__removed"])


def cleaned(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """Stage form: rejected documents go, frequent lines are cut from the rest; the columns of ``docs`` are returned.

    ``n_chars`` is counted anew where a text changed.
    """
    found = judged(docs, host, limits).where(~F.col("kept") | F.col("removed").isNotNull())
    found = found.groupBy(F.col("text_key").alias("__text_key")).agg(F.first("kept").alias("__kept"), F.first("removed").alias("__removed"))
    acts = store.written(found, "quality-verdicts")  # only texts to drop or to cut: the smaller side of the join
    columns = docs.columns
    joined = docs.withColumn("__text_key", F.xxhash64("doc_id", host, "text")).join(acts.hint("shuffle_hash"), "__text_key", "left")
    joined = joined.where(F.coalesce("__kept", F.lit(True))).drop("__text_key", "__kept")
    schema = joined.drop("__removed").schema
    out = joined.mapInArrow(without_lines, schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(store.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


def op6_sql(limits: Limits = Limits()) -> str:
    """The registered query in DuckDB's SQL, on the lines themselves in place of hashes."""
    leads = "".join(f", lead(word, {k}) OVER o" for k in range(1, limits.anchor_words))
    word = r"'[^\x20\x09-\x0D]+'"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {word}) AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
five AS (
  SELECT r, i, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS five, lead(word, 4) OVER o AS fifth
  FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM five WHERE fifth IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, five) > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS x(k) GROUP BY r),
x AS (SELECT r, host, unnest(string_split(t, chr(10))) AS raw, unnest(range(len(string_split(t, chr(10))))) AS place FROM d),
l AS (
  SELECT r, host, raw, place, len(regexp_extract_all(raw, {word})) AS size,
    translate(array_to_string(regexp_extract_all(raw, {word}), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line FROM x),
dup AS (SELECT r, count(*) - count(DISTINCT raw) AS n FROM l WHERE size > 0 GROUP BY r),
g AS (SELECT r, host, line, min(place) AS place, min(size) AS size, sum(size) AS n FROM l WHERE size > 0 GROUP BY r, host, line),
m AS (SELECT g.*, row_number() OVER () AS id, count(*) OVER (PARTITION BY host, line) AS same FROM g),
lw AS (SELECT id, unnest(string_split(line, ' ')) AS word, unnest(range(len(string_split(line, ' ')))) AS i FROM m),
runs AS (SELECT id, [word{leads}] AS anchor, lead(word, {limits.anchor_words - 1}) OVER o AS last FROM lw WINDOW o AS (PARTITION BY id ORDER BY i)),
firsts AS (SELECT id, anchor FROM runs WHERE last IS NOT NULL QUALIFY dense_rank() OVER (PARTITION BY id ORDER BY anchor) <= {limits.anchors}),
a AS (SELECT DISTINCT m.id, host, same, anchor FROM firsts JOIN m USING (id)),
known AS (SELECT DISTINCT host, anchor FROM a WHERE same > {limits.line_documents}),
altered AS (
  SELECT DISTINCT a.id FROM a JOIN known ON a.anchor = known.anchor AND a.host IS NOT DISTINCT FROM known.host WHERE same <= {limits.line_documents}),
own AS (
  SELECT m.r, count(*) FILTER (same <= {limits.line_documents}) AS own, arg_min(m.line, same * 4294967296 + place) FILTER (same > {limits.line_documents}) AS rarest,
    list(m.line ORDER BY m.line) AS all_lines, list(m.line ORDER BY m.line) FILTER (same <= {limits.line_documents} AND size >= {limits.anchor_words} AND altered.id IS NULL) AS left_lines
  FROM m LEFT JOIN altered USING (id) GROUP BY m.r),
kinds AS (
  SELECT r, CASE WHEN own = 0 THEN all_lines WHEN left_lines IS NULL THEN [rarest] ELSE left_lines END AS kind,
    CASE WHEN own = 0 THEN 0 WHEN left_lines IS NULL THEN 1 ELSE 2 END AS way FROM own),
sizes AS (SELECT host, count(*) AS documents FROM d GROUP BY host),
seen AS (
  SELECT host, line, count(*) AS documents, CASE WHEN min(size) < {limits.min_line_words} THEN {limits.short_factor} ELSE 1 END AS factor
  FROM (SELECT DISTINCT host, line, size, way, kind FROM m JOIN kinds USING (r) WHERE same > {limits.line_documents}) GROUP BY host, line),
frequent AS (
  SELECT seen.host, line FROM seen JOIN sizes ON seen.host IS NOT DISTINCT FROM sizes.host
  WHERE seen.documents > factor * {limits.line_documents} AND seen.documents > factor * sizes.documents * {limits.line_percent}::DOUBLE / 100),
lost AS (
  SELECT r, sum(n) AS removed FROM m JOIN frequent ON m.line = frequent.line AND m.host IS NOT DISTINCT FROM frequent.host GROUP BY r),
counted AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN repeated USING (r) LEFT JOIN lost USING (r)),
failed AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_percent} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
  NOT base_failed AND NOT (100 * removed_words > {limits.depleted_percent} * n_words OR (removed_words > 0 AND n_words - removed_words < {limits.min_words})) AS kept
FROM failed"""
