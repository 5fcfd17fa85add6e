"""Gaussian kernels over very many points, block by block: no table of all pairs is written unless pairs are the result.

Points are dealt into blocks of about ``block`` rows, and blocks into bands, at most BANDS of them in a group. A task has one band (or two, for a tile of a
matrix) and sees the group's bands stream past it, one at a time; of two bands it works on pieces of BLOCK points, so it holds the vectors of a few
bands and a BLOCK by BLOCK matrix. What is shuffled is points times bands, however small blocks are, and grows with the points. Distances are
computed again in each pass, from the same written blocks and so to the same bits, which is cheaper than reading n^2 of them back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaprobe.sources.shared import written

FLOAT_EPS = 1.1920928955078125e-07
BLOCK = 1000
BANDS = 32
TILE_BLOCKS = 3 * BLOCK  # points along the side of a tile that one task fills
BINS = 1 << 16
DOUBLE_MAX = float(np.finfo(np.float64).max)


Finish = Callable[[np.ndarray], np.ndarray]


class Block(NamedTuple):
    """Points ``ids`` with their vectors ``x`` and further numbers ``extra``, a row each; ``told`` holds numbers of the group."""

    col: int
    ids: pa.Array
    x: np.ndarray
    extra: np.ndarray
    told: np.ndarray


def packed(points: DataFrame, group: str, ident: str, vec: str, extra: Column | None = None, block: int = BLOCK) -> DataFrame:
    """group, blocks, block, ids, x, extra: a row per block, vectors one after the other, written once."""
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    blocks = points.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = points.select(group, F.col(ident).alias("_id"), F.col(vec).cast("array<double>").alias("_x"), (F.array().cast("array<double>") if extra is None else extra).alias("_e"))
    rows = rows.join(blocks, group).withColumn("block", F.pmod(F.xxhash64("_id"), F.col("blocks")).cast("int"))
    one = F.sort_array(F.collect_list(F.struct("_id", "_x", "_e"))).alias("p")  # of a block, which is bounded
    out = rows.groupBy(group, "blocks", "block").agg(one)
    out = out.select(group, "blocks", "block", F.col("p._id").alias("ids"), F.flatten("p._x").alias("x"), F.flatten("p._e").alias("extra"))
    return written(out.select(group, "blocks", "block", F.col("ids").cast(f"array<{kinds[ident]}>").alias("ids"), "x", "extra"), "blocks")


def _read(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[tuple[tuple, Block]]:
    """((group, tile, col), block) of each row."""
    for batch in batches:
        keys = [batch.column(c).to_pylist() for c in (group, "tile", "col")]
        ids, x, extra, told = (batch.column(c) for c in ("ids", "x", "extra", "told"))
        for i in range(batch.num_rows):
            n = len(ids[i])
            values = [c[i].values.to_numpy(zero_copy_only=False) if c[i].is_valid else np.empty(0) for c in (x, extra, told)]
            yield (keys[0][i], keys[1][i], keys[2][i]), Block(keys[2][i], ids[i].values, values[0].reshape(n, -1), values[1].reshape(n, -1), values[2])


def _banded(rows: Iterator[tuple[tuple, Block]]) -> Iterator[tuple[tuple, Block]]:
    """Neighbouring rows of one key as one block, which is a copy: none holds on to the batch it came in."""
    for key, own in groupby(rows, key=lambda row: row[0]):
        blocks = [b for _, b in own]
        yield key, Block(blocks[0].col, pa.concat_arrays([b.ids for b in blocks]), *(np.concatenate([getattr(b, c) for b in blocks]) for c in ("x", "extra")), blocks[0].told.copy())


def pieces(row: Block, col: Block, half: bool = False) -> Iterator[tuple[slice, Block, Block]]:
    """Two bands in pieces of BLOCK points at most, with the rows' places; ``half``: of a band with itself, no piece below the diagonal."""
    def cut(band: Block, at: slice) -> Block:
        return band._replace(ids=band.ids[at], x=band.x[at], extra=band.extra[at])

    same = half and row.ids.equals(col.ids)
    for a in range(0, len(row.ids), BLOCK):
        for b in range(a if same else 0, len(col.ids), BLOCK):
            yield slice(a, a + BLOCK), cut(row, slice(a, a + BLOCK)), cut(col, slice(b, b + BLOCK))


def streamed(sides: list[DataFrame], group: str, fn: Callable[[object, Iterator[Block]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` gets a group's name and, in order of ``col``, the bands of one tile; rows of ``sides``: group, tile, col, block, ids, x, extra, told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, _), blocks in groupby(_banded(_read(batches, group)), key=lambda row: row[0][:2]):
            yield from fn(name, (block for _, block in blocks))

    rows = sides[0]
    for side in sides[1:]:
        rows = rows.unionByName(side)
    return rows.repartition(group, "tile").sortWithinPartitions(group, "tile", "col", "block").drop("block").mapInArrow(run, schema)


def _side(blocks: DataFrame, group: str, tile: Column, col: Column) -> DataFrame:
    return blocks.select(group, tile.alias("tile"), col.cast("long").alias("col"), "block", "ids", "x", "extra", "told")


def _bands(per: Column) -> tuple[Column, Column]:
    """A block's band and the group's number of bands, of ``per`` blocks each."""
    return F.floor(F.col("block") / per).cast("long"), F.ceil(F.col("blocks") / per).cast("long")


def row_blocks(blocks: DataFrame, group: str, half: bool = False) -> list[DataFrame]:
    """Each band, then all bands of its group (``half``: itself and those after it) as its columns."""
    own, n = _bands(F.ceil(F.col("blocks") / BANDS))
    return [_side(blocks, group, own, F.lit(-1)), _side(blocks, group, F.explode(F.sequence(F.lit(0).cast("long"), own if half else n - 1)), own)]


def told(blocks: DataFrame, numbers: DataFrame, group: str, *columns: str) -> DataFrame:
    """Blocks with numbers of their group."""
    return blocks.join(numbers.select(group, F.array(*[F.col(c).cast("double") for c in columns]).alias("told")), group)


def squared_distances(a: Block, b: Block) -> np.ndarray:
    d2 = (a.x * a.x).sum(1)[:, None] + (b.x * b.x).sum(1)[None, :]
    d2 -= 2 * a.x @ b.x.T
    np.maximum(d2, 0, out=d2)
    if a.ids.equals(b.ids):
        np.fill_diagonal(d2, 0)
    return d2


def upper_distances(a: Block, b: Block) -> np.ndarray:
    """Of each unordered pair once; ``b`` is ``a`` or a later block."""
    d2 = squared_distances(a, b)
    return d2[np.triu_indices(len(d2), 1)] if a.ids.equals(b.ids) else d2.ravel()


def bandwidth(blocks: DataFrame, group: str, bins: int = BINS) -> DataFrame:
    """group, eps: the lower median of the squared distances of all pairs, exact, at least the float's epsilon.

    Passes over the distances count them in ``bins`` ranges of equal width of their bit patterns (which order as they do). The range that
    holds the median is cut again, between the least and largest distance seen in it, until these are equal; a distance that
    many pairs share ends it at once. Groups of one point have no distance and give the epsilon.
    """
    names, kind = blocks.select(group).distinct(), dict(blocks.dtypes)[group]

    def counts(name: object, own: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        row = next(own)
        low, high = row.told.view(np.int64).tolist()
        width = -(-(high - low + 1) // bins)
        n, least, most = np.zeros(bins, np.int64), np.full(bins, np.inf), np.full(bins, -np.inf)
        for _, a, b in (piece for col in own for piece in pieces(row, col, half=True)):
            d2 = upper_distances(a, b)
            d2 = d2[(d2 >= row.told[0]) & (d2 <= row.told[1])]
            at = (d2.view(np.int64) - low) // width
            n += np.bincount(at, minlength=bins)
            np.minimum.at(least, at, d2)
            np.maximum.at(most, at, d2)
        some = np.flatnonzero(n)
        columns = [pa.array([name] * len(some), _arrow(kind)), *(pa.array(x[some]) for x in (n, least, most))]
        yield pa.RecordBatch.from_arrays([columns[0], pa.array(some), *columns[1:]], names=[group, "bin", "n", "least", "most"])

    schema = f"{group} {kind}, bin bigint, n bigint, least double, most double"
    ranges = names.select(group, F.lit(0.0).alias("low"), F.lit(DOUBLE_MAX).alias("high"), F.lit(None).cast("bigint").alias("rank"))
    while True:
        settled, left = ranges.where("low = high"), ranges.where("low < high")
        seen = streamed(row_blocks(told(blocks, left, group, "low", "high"), group, half=True), group, counts, schema)
        seen = seen.groupBy(group, "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        w = Window.partitionBy(group)  # at most ``bins`` rows a group
        seen = seen.select("*", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.ceil(F.sum("n").over(w) / 2).alias("half"))
        seen = seen.join(left.select(group, "rank"), group).withColumn("rank", F.coalesce("rank", "half"))
        chosen = seen.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        chosen = chosen.select(group, F.col("least").alias("low"), F.col("most").alias("high"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
        ranges = written(settled.unionByName(chosen), "ranges")
        if ranges.where("low < high").isEmpty():
            return names.join(ranges, group, "left").select(group, F.greatest(F.coalesce("low", F.lit(0.0)), F.lit(FLOAT_EPS)).alias("eps"))


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[kind]


def kernel_of(row: Block, col: Block, eps: float) -> np.ndarray:
    d2 = squared_distances(row, col)
    d2 /= -2 * eps
    return np.exp(d2, out=d2)


def _scaled(row: Block, col: Block, eps: float) -> np.ndarray:
    """The symmetric kernel of two blocks whose first extra number scales it. The distance of a point to itself is 0, also where
    only a part of a band is met."""
    out = np.empty((len(row.ids), len(col.ids)))
    for at, a, b in pieces(row, col):
        out[at] = kernel_of(a, b, eps)
    out *= row.extra[:, :1]
    out *= col.extra[:, :1].T
    return out


def times(blocks: DataFrame, group: str, eps: DataFrame, squares: bool = False) -> DataFrame:
    """group, ident as ``id``, extra, product: per point its row of the kernel times the points' ``extra`` (a column for each number), without the
    kernel. ``squares``: instead the sum of squares of the row after ``extra``, one number, scales rows and columns."""
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}

    def products(name: object, own: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        row = next(own)
        total = np.zeros((len(row.ids), 1 if squares else row.extra.shape[1]))
        for at, a, b in (piece for col in own for piece in pieces(row, col)):
            if row.extra.shape[1]:
                kern = kernel_of(a, b, row.told[0])
                total[at] += ((kern * a.extra * b.extra.T) ** 2).sum(1)[:, None] if squares else kern @ b.extra
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(row.ids), _arrow(kinds[group])), row.ids, listed(row.extra), listed(total)], names=[group, "id", "extra", "product"])

    schema = f"{group} {kinds[group]}, id {kinds['ids'][6:-1]}, extra array<double>, product array<double>"
    return streamed(row_blocks(told(blocks, eps, group, "eps"), group), group, products, schema)


def listed(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(matrix).ravel(), pa.float64()))


def mixing_constant(degrees: DataFrame, group: str) -> DataFrame:
    """group, c_value of the stationary distribution that degrees stand for."""
    share = F.min("d") / F.sum("d")
    return degrees.groupBy(group).agg((1 / F.sqrt(share) / F.log(F.lit(2.0))).alias("c_value"))


def degrees(points: DataFrame, group: str, ident: str, vec: str, alpha: float = 0.0, block: int = BLOCK) -> DataFrame:
    """group, ident, vec, eps, d: row sums of the kernel, each point with itself included; after ``alpha`` > 0 those of d_i^-alpha K d_j^-alpha, with ``weight`` d^-alpha."""
    once = packed(points, group, ident, vec, F.array(F.lit(1.0)), block)
    eps = written(bandwidth(once, group), "bandwidth")
    found = times(once, group, eps).select(group, F.col("id").alias(ident), F.col("product")[0].alias("d"))
    out = written(points.select(group, ident, F.col(vec).alias("vec")).join(found, [group, ident]).join(eps, group).withColumn("weight", F.lit(1.0)), "degrees")
    if not alpha:
        return out
    scaled = out.withColumn("weight", F.pow("d", F.lit(-alpha)))
    again = times(packed(scaled, group, ident, "vec", F.array("weight"), block), group, eps).select(group, F.col("id").alias(ident), F.col("product")[0].alias("p"))
    return written(scaled.join(again, [group, ident]).withColumn("d", F.col("p") * F.col("weight")).drop("p"), "degrees")


def scaled_blocks(points: DataFrame, group: str, ident: str, *columns: Column, block: int = BLOCK) -> DataFrame:
    """Blocks of the points of ``degrees`` with what the symmetric kernel takes: weight / sqrt(d), and ``columns``."""
    return packed(points, group, ident, "vec", F.array(F.col("weight") / F.sqrt("d"), *columns), block)


def distances(points: DataFrame, group: str, ident: str, vec: str, block: int = BLOCK, finish: Finish | None = None) -> DataFrame:
    """group, i, j (i < j), d2 of all pairs, which are the result here; ``finish`` is done to the numbers of a piece before they leave the task."""
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    blocks = packed(points, group, ident, vec, block=block).withColumn("told", F.array().cast("array<double>"))

    def pairs(name: object, own: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        row = next(own)
        for _, a, b in (piece for col in own for piece in pieces(row, col, half=True)):
            yield ordered_pairs(name, kinds[group], group, a, b, _finished(squared_distances(a, b), finish), "d2")

    return streamed(row_blocks(blocks, group, half=True), group, pairs, f"{group} {kinds[group]}, i {kinds[ident]}, j {kinds[ident]}, d2 double")


def _finished(values: np.ndarray, finish: Finish | None) -> np.ndarray:
    return values if finish is None else finish(values)


def half_up(digits: int, scale: float = 1.0) -> Finish:
    """Numbers times ``scale``, rounded as SQL's round does (halves away from zero); no negative zero. In the task, where it costs a few
    nanoseconds a number; Spark's round goes through a decimal each."""
    power = 10.0**digits

    def finish(values: np.ndarray) -> np.ndarray:
        out = values * scale
        return np.copysign(np.floor(np.abs(out) * power + 0.5) / power, out) + 0.0

    return finish


def _repeated(name: object, kind: str, n: int) -> pa.Array:
    return pa.repeat(pa.scalar(name, _arrow(kind)), n)


def ordered_pairs(name: object, kind: str, group: str, row: Block, col: Block, values: np.ndarray, value: str) -> pa.RecordBatch:
    """Each unordered pair of two blocks (of one block: each pair of different points) once, the smaller id first."""
    if row.ids.equals(col.ids):
        upper = np.triu(np.ones(values.shape, bool), 1)
        i, j = np.nonzero(upper)
        numbers = values[upper]
    else:
        i, j, numbers = np.repeat(np.arange(len(row.ids)), len(col.ids)), np.tile(np.arange(len(col.ids)), len(row.ids)), values.ravel()
    if pa.types.is_integer(row.ids.type):
        one, two = row.ids.to_numpy()[i], col.ids.to_numpy()[j]
        low, high = pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))
    else:
        one, two = row.ids.take(pa.array(i)), col.ids.take(pa.array(j))
        swap = pc.greater(one, two)
        low, high = pc.if_else(swap, two, one), pc.if_else(swap, one, two)
    return pa.RecordBatch.from_arrays([_repeated(name, kind, len(i)), low, high, pa.array(numbers)], names=[group, "i", "j", value])


def symmetric_pairs(points: DataFrame, group: str, ident: str, block: int = BLOCK, finish: Finish | None = None) -> DataFrame:
    """group, i, j, m = K / sqrt(d_i d_j) for all ordered pairs, the diagonal included: here the pairs are the result."""
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    blocks = scaled_blocks(points, group, ident, block=block)

    def pairs(name: object, own: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        row = next(own)
        for _, a, b in (piece for col in own for piece in pieces(row, col)):
            m = kernel_of(a, b, row.told[0])
            m *= a.extra
            m *= b.extra.T
            i, j = np.repeat(np.arange(len(a.ids)), len(b.ids)), np.tile(np.arange(len(b.ids)), len(a.ids))
            yield pa.RecordBatch.from_arrays([_repeated(name, kinds[group], m.size), a.ids.take(pa.array(i)), b.ids.take(pa.array(j)), pa.array(_finished(m, finish).ravel())], names=[group, "i", "j", "m"])

    eps = points.select(group, "eps").distinct()
    return streamed(row_blocks(told(blocks, eps, group, "eps"), group), group, pairs, f"{group} {kinds[group]}, i {kinds[ident]}, j {kinds[ident]}, m double")


def diffusion_distance_one(points: DataFrame, group: str, ident: str, vec: str, block: int = BLOCK, finish: Finish | None = None) -> DataFrame:
    """group, i, j (i < j), dist2: squared diffusion distances at time 1 over all non-trivial pairs, without eigenvectors.

    sum_k lambda_k^2 (psi_k(i) - psi_k(j))^2 = (M^2)_ii + (M^2)_jj - 2 (M^2)_ij - (sqrt d_i - sqrt d_j)^2 / sum d. A tile of M^2 is one task's: the
    bands of its rows and of its columns stay (TILE_BLOCKS points each), all bands stream past them, and the products of the two kernels that each gives are
    added up. The work is n^3; what is shuffled is points times tiles.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    base = degrees(points, group, ident, vec, block=block)
    eps = base.select(group, "eps").distinct()
    whole = base.groupBy(group).agg(F.sum("d").alias("total"), F.first("eps").alias("eps"))
    selves = times(scaled_blocks(base, group, ident, block=block), group, eps, squares=True).select(group, F.col("id").alias(ident), F.col("product")[0].alias("own"))
    base = written(base.join(selves, [group, ident]), "selves")
    blocks = told(scaled_blocks(base, group, ident, F.sqrt("d"), F.col("own"), block=block), whole, group, "eps", "total")
    b, n = _bands(F.lit(max(1, TILE_BLOCKS // block)))
    every = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.transform(F.sequence(i, n - 1), lambda j: i * n + j)))
    sides = [
        _side(blocks, group, F.explode(F.transform(F.sequence(b, n - 1), lambda j: b * n + j)), F.lit(-2)),
        _side(blocks, group, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), b), lambda i: i * n + b)), F.lit(-1)),
        _side(blocks, group, F.explode(every), b),
    ]

    def tile(name: object, own: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        row, col = next(own), next(own)
        eps, total = row.told.tolist()
        square = np.zeros((len(row.ids), len(col.ids)))
        for mid in own:
            for at in range(0, len(mid.ids), BLOCK):
                some = mid._replace(ids=mid.ids[at : at + BLOCK], x=mid.x[at : at + BLOCK], extra=mid.extra[at : at + BLOCK])
                left, right = (_scaled(row, some, eps), None if row.ids.equals(col.ids) else _scaled(col, some, eps))
                square += left @ (left if right is None else right).T
        (root_i, own_i), (root_j, own_j) = row.extra[:, 1:].T, col.extra[:, 1:].T
        dist2 = own_i[:, None] + own_j[None, :] - 2 * square - (root_i[:, None] - root_j[None, :]) ** 2 / total
        places = {c: np.arange(len(side.ids)) for c, side in (("i", row), ("j", col))}
        rows, cols = row._replace(extra=places["i"][:, None]), col._replace(extra=places["j"][:, None])
        for _, a, b in pieces(rows, cols, half=True):
            yield ordered_pairs(name, kinds[group], group, a, b, _finished(dist2[np.ix_(a.extra[:, 0], b.extra[:, 0])], finish), "dist2")

    return streamed(sides, group, tile, f"{group} {kinds[group]}, i {kinds[ident]}, j {kinds[ident]}, dist2 double")
