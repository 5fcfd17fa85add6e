"""Pooling of activations, centroids, and linear CKA in three plans.

Activations are token rows: keys..., call_idx, time_idx, token_idx, vec ARRAY. Plans for CKA:
``cka`` sends one key's matrices to one Python task (default); ``cka_relational`` stays in SQL and makes tokens * width^2
rows per key (small widths); ``cka_moments`` adds up mergeable moments per partition first (very many tokens per key).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaprobe.functions import exprs
from tessaprobe.sources.shared import written

EPS = 1e-12
HELD_NUMBERS = 1 << 23  # of sums that a task keeps before it hands them on
MANY_KEYS = 1000  # of a batch; with a quarter as many keys as rows or more, sums go on without being kept


def vector_sums(df: DataFrame, keys: Sequence[str], vec: str, count: str | None = None) -> DataFrame:
    """keys, sum, n: element-wise sums of a key's vectors and how many they are (a row counts as ``count`` of them). Tasks add up their own
    rows first, so a key is shuffled once for each task that has it; sums of sums follow, one key at a time.

    Null vectors are left out; vectors of one key that differ in length, or hold a null, are an error.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*keys).schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", sum array<double>, n bigint"
    rows = df.where(F.col(vec).isNotNull()).select(*keys, F.col(vec).cast("array<double>").alias("sum"), (F.col(count) if count else F.lit(1)).cast("bigint").alias("n"))
    ordered = rows.mapInArrow(lambda b: _added(b, list(keys), False), schema).repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(lambda b: _added(b, list(keys), True), schema)


def _added(batches: Iterator[pa.RecordBatch], keys: list[str], ordered: bool) -> Iterator[pa.RecordBatch]:
    """Sums by key over batches: what is held goes on when it is much, or, of rows in order of keys, when a batch has passed the key.

    Keys that can't go on in a later batch are added up together: of rows in order all but the first and the last. So are those of a batch with very many keys.
    """
    held: dict[tuple, list] = {}
    schema = None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        own = [held.pop(k) for k in rows]
        columns = [pa.array([k[i] for k in rows], schema.field(i).type) for i in range(len(keys))]
        lists = pa.array([x for x, _ in own], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*columns, lists, pa.array([n for _, n in own], pa.int64())], names=[*keys, "sum", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        schema = batch.schema
        if batch.column("sum").flatten().null_count:
            raise ValueError("vectors must not hold nulls")
        code = batch.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) > 0]))
        part = batch.take(pa.array(order))
        sizes, flat = np.diff(part.column("sum").offsets.to_numpy()), part.column("sum").flatten().to_numpy()
        ends, n = np.cumsum(sizes), np.add.reduceat(part.column("n").to_numpy(), starts)
        direct = range(0)
        if sizes[0] and (sizes == sizes[0]).all():
            direct = range(1, len(starts) - 1) if ordered else range(len(starts) if len(starts) > MANY_KEYS and 4 * len(starts) > len(order) else 0)
        kept, bounds = [g for g in range(len(starts)) if g not in direct], [*starts.tolist(), len(order)]
        names = zip(*(part.column(k).take(pa.array(starts[kept])).to_pylist() for k in keys), strict=True)
        for g, name in zip(kept, names, strict=True):
            a, b = bounds[g], bounds[g + 1]
            width = int(sizes[a])
            if (sizes[a:b] != width).any() or (name in held and len(held[name][0]) != width):
                raise ValueError(f"vectors of {name} differ in length")
            total = flat[ends[a] - width : ends[b - 1]].reshape(b - a, width).sum(0)
            if name in held:
                held[name][0] += total
                held[name][1] += int(n[g])
            else:
                held[name] = [total, int(n[g])]
        if direct:
            width, some = int(sizes[0]), slice(direct.start, direct.stop)
            sums = np.add.reduceat(flat.reshape(-1, width), starts, axis=0)[some]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * width), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(starts[some])) for k in keys), lists, pa.array(n[some])], names=[*keys, "sum", "n"])
        last = tuple(batch.column(k)[-1].as_py() for k in keys)
        done = [k for k in held if k != last] if ordered else list(held) if sum(len(x) for x, _ in held.values()) > HELD_NUMBERS else []
        if done:
            yield out(done)
    if held:
        yield out(list(held))


def vector_mean(df: DataFrame, keys: Sequence[str], vec: str, count: str | None = None) -> DataFrame:
    """Element-wise mean of equal-length vectors."""
    return _means(vector_sums(df, keys, vec), keys, vec, count)


def _means(sums: DataFrame, keys: Sequence[str], vec: str, count: str | None = None) -> DataFrame:
    mean = F.transform("sum", lambda x: x / F.col("n"))
    return sums.select(*keys, mean.alias(vec), *([F.col("n").alias(count)] if count else []))


def _but_last(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, one per key, call and token, without each key's last call if it has several."""
    last = calls.groupBy(*keys).agg(F.max("call_idx").alias("_last"))
    same = functools.reduce(lambda a, b: a & b, [calls[k].eqNullSafe(last[k]) for k in keys])
    kept = (F.col("call_idx") < F.col("_last")) | (F.col("_last") == 0)
    return calls.join(last, same).where(kept).select(calls["*"])


def pool_first(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over time of the first call."""
    return vector_mean(df.where("call_idx = 0"), [*keys, "token_idx"], "vec")


def pool_drop_last(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over time and calls without the last call, if there are several. Calls are summed before the last one is looked for."""
    calls = _but_last(vector_sums(df, [*keys, "call_idx", "token_idx"], "vec"), keys)
    return _means(vector_sums(calls, [*keys, "token_idx"], "sum", "n"), [*keys, "token_idx"], "vec")


def pool_mean_of_means(df: DataFrame, keys: Sequence[str], drop_last: bool = False) -> DataFrame:
    """Mean of the calls' means, each call counting alike."""
    calls = vector_mean(df, [*keys, "call_idx", "token_idx"], "vec")
    return vector_mean(_but_last(calls, keys) if drop_last else calls, [*keys, "token_idx"], "vec")


def pool_concat(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All calls' time rows in a row, renumbered; nothing is averaged."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy("call_idx", "time_idx")) - 1
    return df.withColumn("_k", k).select(*keys, F.col("_k").alias("token_idx"), "vec")


def first_segment(df: DataFrame) -> DataFrame:
    """Rows of the first call as they are; of a batch, where one is told (``batch_idx``), its first item."""
    kept = df.where("call_idx = 0")
    return kept.where("batch_idx = 0") if "batch_idx" in df.columns else kept


def known_layers(df: DataFrame, first: DataFrame) -> DataFrame:
    """Only layers that the first utterance has."""
    return df.join(first.select("layer").distinct(), "layer", "left_semi")


def pool_with(df: DataFrame, keys: Sequence[str], fn: Callable, schema: str) -> DataFrame:
    """A user's pooling: ``fn`` gets one key's rows as a pandas frame."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def extract_with(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """A user's activation producer: ``fn`` gets pandas batches of waveforms and yields frames of activation rows."""
    return df.mapInPandas(fn, schema)


def extract_with_enhanced(df: DataFrame, fn: Callable, schema: str, keys: Sequence[str], samples: str = "samples") -> tuple[DataFrame, DataFrame]:
    """A model that gives both: (activation rows as in ``schema``, (keys, enhanced) of the same waves), from one pass of ``fn``.

    ``fn`` gets a pandas batch (keys, samples) and returns two frames: activation rows, and one row (keys, enhanced) per wave, in
    order of the batch, whose signal is cut to its input's length. Both kinds of rows are written once and told apart afterwards.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*keys).schema}
    fields = dict(x.strip().split(" ", 1) for x in _top_level(schema))
    every = {"_kind": "int", **fields, **{k: kinds[k] for k in keys}, "enhanced": "array<double>"}

    def filled(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(**{c: pd.Series([None] * len(frame), frame.index, dtype=object) for c in every if c not in frame.columns})[list(every)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, better = fn(frame)
            if len(better) != len(frame):
                raise ValueError(f"{len(better)} enhanced signals of {len(frame)} waves")
            yield filled(rows.assign(_kind=0).reset_index(drop=True))
            cut = [None if y is None else np.asarray(y, np.float64)[: len(x)] for x, y in zip(frame[samples], better["enhanced"], strict=True)]
            yield filled(better[list(keys)].assign(enhanced=pd.Series(cut, index=better.index, dtype=object), _kind=1))

    both = written(df.select(*keys, samples).mapInPandas(run, ", ".join(f"`{k}` {v}" for k, v in every.items())), "produced")
    return both.where("_kind = 0").select(*fields), both.where("_kind = 1").select(*keys, "enhanced")


def _top_level(schema: str) -> list[str]:
    """The fields of a schema's text; commas inside < > or ( ) part none."""
    parts, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def centroids(df: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    return vector_mean(df, keys, vec, "n_samples")


def paired(clean: DataFrame, degraded: DataFrame, keys: Sequence[str], strict: bool = True) -> DataFrame:
    """keys, token_idx, x, y of the tokens of both sides; a token of one side only, or of another width, is an error. Not ``strict``: tokens that
    one side lacks are left out."""
    x, y = clean.select(*keys, "token_idx", F.col("vec").alias("x")), degraded.select(*keys, "token_idx", F.col("vec").alias("y"))
    if not strict:
        return x.join(y, [*keys, "token_idx"])
    same = F.coalesce(F.size("x") == F.size("y"), F.lit(False))
    checked = x.join(y, [*keys, "token_idx"], "full").withColumn("_ok", F.assert_true(same, F.lit("clean and degraded activations differ in shape")))
    return checked.where("_ok is null").drop("_ok")


def linear_cka(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x - x.mean(axis=0), y - y.mean(axis=0)
    cross = np.sum((x.T @ y) ** 2)
    return float(min(1.0, max(0.0, cross / (np.sqrt(np.sum((x.T @ x) ** 2)) * np.sqrt(np.sum((y.T @ y) ** 2)) + EPS))))


def cka(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, CKA: one key's tokens in one task, as matrices."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keys).schema)

    def one(frame):
        value = linear_cka(np.array(frame["x"].tolist(), np.float64), np.array(frame["y"].tolist(), np.float64))
        return frame[list(keys)].head(1).assign(CKA=value)

    return pairs.groupBy(*keys).applyInPandas(one, f"{kinds}, CKA double")


def cka_of_conditions(pooled: DataFrame, shared: Sequence[str], conditions: Sequence[str]) -> DataFrame:
    """shared, conditions, CKA: pooled tokens (shared, conditions, token_idx, vec) of every condition against the clean ones of the same
    ``shared`` keys, whose conditions are all null.

    One shuffle brings a key's rows together in order, the clean ones first: a task keeps the clean matrix and lets the conditions stream
    past it, one at a time, so clean tokens are not repeated for each of them. A condition whose tokens are not the clean ones', or of another
    width, is an error; so is one without clean tokens. Keys with clean tokens only give no row.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pooled.schema}
    shared, conditions = list(shared), list(conditions)
    clean = functools.reduce(lambda a, b: a & b, [F.col(c).isNull() for c in conditions])
    order = [*shared, "_side", *conditions, "token_idx"]
    rows = pooled.select(*shared, *conditions, "token_idx", F.col("vec").cast("array<double>").alias("vec"), F.when(clean, 0).otherwise(1).alias("_side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tokens, vectors, reference = None, [], [], None  # now: (shared key, side, conditions) of the rows that are held; vectors: a matrix per run of rows

        def compared() -> tuple | None:
            nonlocal reference
            key, side, own = now
            if any(v is None or v.shape[1] != vectors[0].shape[1] for v in vectors):
                raise ValueError(f"activations of {key}, {own} differ in shape")
            matrix = np.concatenate(vectors)
            if side == 0:
                reference = (key, tokens, matrix)
                return None
            if reference is None or reference[0] != key or reference[1] != tokens or matrix.shape != reference[2].shape:
                raise ValueError(f"clean and degraded activations of {key}, {own} differ in shape")
            return (*key, *own, linear_cka(reference[2], matrix))

        for batch in batches:
            if not batch.num_rows:
                continue
            out, keyed = [], batch.select([*shared, "_side", *conditions])
            code = keyed.to_pandas().groupby(keyed.schema.names, dropna=False, sort=False).ngroup().to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], np.diff(code) != 0]))
            names = zip(*(keyed.column(c).take(pa.array(starts)).to_pylist() for c in keyed.schema.names), strict=True)
            vecs, idx = batch.column("vec"), batch.column("token_idx").to_pylist()
            offsets, flat = vecs.offsets.to_numpy(), vecs.values.to_numpy(zero_copy_only=False)
            for name, a, b in zip(names, starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                mine = (name[: len(shared)], name[len(shared)], name[len(shared) + 1 :])
                if mine != now:
                    if now is not None and (found := compared()):
                        out.append(found)
                    now, tokens, vectors = mine, [], []
                tokens += idx[a:b]
                widths = set(np.diff(offsets[a : b + 1]).tolist())
                vectors.append(flat[offsets[a] : offsets[b]].reshape(b - a, -1).copy() if len(widths) == 1 else None)
            schema = pa.schema([*(batch.schema.field(c) for c in (*shared, *conditions)), ("CKA", pa.float64())])
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)
        if now is not None and (found := compared()):
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, found, strict=True))], schema)

    dealt = rows.repartition(*shared).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (*shared, *conditions)) + ", CKA double")


def cka_relational(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same in SQL: centre each feature, sum products over tokens, then square and sum."""
    def long(v: str) -> DataFrame:
        w = Window.partitionBy(*keys, "i")
        return pairs.select(*keys, "token_idx", F.posexplode(v).alias("i", "v")).withColumn("v", F.col("v") - F.avg("v").over(w))

    def gram(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        right = b.withColumnRenamed("i", "j").withColumnRenamed("v", "u")
        sums = a.join(right, [*keys, "token_idx"]).groupBy(*keys, "i", "j").agg(F.sum(F.col("v") * F.col("u")).alias("s"))
        return sums.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias(name))

    x, y = long("x"), long("y")
    both = gram(x, y, "xy").join(gram(x, x, "xx"), list(keys)).join(gram(y, y, "yy"), list(keys))
    return both.select(*keys, exprs.clamp01(F.col("xy") / (F.sqrt("xx") * F.sqrt("yy") + EPS)).alias("CKA"))


def cka_moments(pairs: DataFrame, keys: Sequence[str], salts: int = 16) -> DataFrame:
    """For keys with very many tokens: per task and key the sums of x, y, xx', xy', yy'; sums of sums give the rest."""
    names = list(keys)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keys).schema)
    schema = f"{kinds}, salt int, n bigint, width int, sums array<double>"

    def partial(frames: Iterator) -> Iterator:
        for frame in frames:
            for key, part in frame.groupby(names, dropna=False):
                x, y = np.array(part["x"].tolist(), np.float64), np.array(part["y"].tolist(), np.float64)
                sums = np.concatenate([x.sum(0), y.sum(0), (x.T @ x).ravel(), (x.T @ y).ravel(), (y.T @ y).ravel()])
                row = part[names].head(1).assign(salt=int(part.index[0]) % salts, n=len(part), width=x.shape[1])
                row["sums"] = [sums]
                yield row

    def added(frame):
        row = frame[names].head(1).assign(salt=0, n=int(frame["n"].sum()), width=int(frame["width"].iloc[0]))
        row["sums"] = [np.sum(np.array(frame["sums"].tolist()), axis=0)]
        return row

    def finish(frame):
        frame = added(frame)
        n, h, s = int(frame["n"].iloc[0]), int(frame["width"].iloc[0]), frame["sums"].iloc[0]
        mx, my = s[:h] / n, s[h : 2 * h] / n
        xx, xy, yy = (s[2 * h + k * h * h : 2 * h + (k + 1) * h * h].reshape(h, h) for k in range(3))
        xx, xy, yy = xx - n * np.outer(mx, mx), xy - n * np.outer(mx, my), yy - n * np.outer(my, my)
        value = np.sum(xy**2) / (np.sqrt(np.sum(xx**2)) * np.sqrt(np.sum(yy**2)) + EPS)
        return frame[names].assign(CKA=min(1.0, max(0.0, float(value))))

    first = pairs.select(*keys, "x", "y").mapInPandas(partial, schema)
    return first.groupBy(*keys, "salt").applyInPandas(added, schema).groupBy(*keys).applyInPandas(finish, f"{kinds}, CKA double")


def decode_f32(column: str):
    """BINARY of float32 -> ARRAY<FLOAT>, once at ingest."""

    @F.pandas_udf("array<float>")
    def decode(values: pd.Series) -> pd.Series:
        sizes = values.map(len, na_action="ignore").fillna(0).to_numpy(np.int64)
        flat = np.frombuffer(b"".join(b for b in values if b is not None), np.float32)
        ends = np.cumsum(sizes) // 4
        return pd.Series([None if b is None else flat[e - n // 4 : e] for b, e, n in zip(values, ends.tolist(), sizes.tolist(), strict=True)])

    return decode(F.col(column))
