"""Leading eigenpairs of the symmetric kernel of groups with very many points, by a block Krylov method without the matrix.

A group's basis has a few numbers per point. Each step multiplies the newest block of it by the kernel (``kernels.times``: distances are made block by block and
thrown away), adds up the inner products of basis and images over tasks, and solves the small problem of the basis, one group in a task. So
n x (width x depth) numbers are written per step and n^2 never.

Where distances are wanted and not the pairs themselves, ``power_coordinates`` needs no convergence: it takes as many directions as a power of the kernel has.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaprobe.functions import exprs
from tessaprobe.operators import kernels
from tessaprobe.operators.kernels import listed
from tessaprobe.sources.shared import written

SMALL = "theta array<double>, ritz array<double>, turn array<double>, residual double, restart boolean"
DROPPED = 1e-10  # directions this much smaller than the largest carry rounding errors only
PROBES = 8  # random vectors that tell what a basis leaves
UNSURE = 100.0  # the square of a matrix' norm is over this many times the mean square of its products with the probes once in ten million times


def _inner_products(state: DataFrame, group: str) -> DataFrame:
    """group, width, sums: Q'Q, Q'Y and Y'Y of each task's rows."""
    kind = dict(state.dtypes)[group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[object, np.ndarray] = {}
        for batch in batches:
            names = batch.column(group).to_pandas()
            for name, rows in names.groupby(names).indices.items():
                part = batch.take(pa.array(rows))
                q, y = (part.column(c).flatten().to_numpy().reshape(len(rows), -1) for c in ("q", "y"))
                total[name] = total.get(name, 0) + np.stack([q.T @ q, q.T @ y, y.T @ y])
        for name, sums in total.items():
            yield pa.RecordBatch.from_pylist([{group: name, "width": sums.shape[1], "sums": sums.ravel()}], pa.schema([(group, kernels._arrow(kind)), ("width", pa.int32()), ("sums", pa.list_(pa.float64()))]))

    return state.select(group, "q", "y").mapInArrow(run, f"{group} {kind}, width int, sums array<double>")


def small_problem(qq: np.ndarray, qy: np.ndarray, yy: np.ndarray, width: int, wanted: int, depth: int, tolerance: float) -> dict:
    """Ritz values and vectors of a basis Q with images Y, the largest residual of the wanted ones, and the combination of (Q, Y) that is
    the basis' next block, or with ``restart`` of Y that is a new first block; no columns once settled. ``width`` is the number of columns of the newest block."""
    values, vectors = np.linalg.eigh((qq + qq.T) / 2)
    some = values > DROPPED * values[-1]
    whiten = vectors[:, some] / np.sqrt(values[some])
    theta, ritz = np.linalg.eigh(whiten.T @ (qy + qy.T) / 2 @ whiten)
    theta, ritz = theta[::-1], (whiten @ ritz)[:, ::-1]
    images = np.einsum("ij,ij->j", ritz, yy @ ritz)
    residual = float(np.sqrt(np.maximum(0, images - theta**2))[:wanted].max())
    if not width or residual <= tolerance:  # settled: no new block
        return {"theta": theta, "ritz": ritz, "turn": np.empty((0, 0)), "residual": 0.0, "restart": False}
    first = min(len(theta), wanted + 4)
    if qq.shape[0] >= depth * width:
        turn = ritz[:, :first] / np.sqrt(np.maximum(images[:first], 1e-300))
        return {"theta": theta, "ritz": ritz, "turn": turn, "residual": residual, "restart": True}
    new = slice(qq.shape[0] - width, None)
    along = np.linalg.pinv(qq, rcond=DROPPED, hermitian=True) @ qy[:, new]
    left = yy[new, new] - qy[:, new].T @ along
    values, vectors = np.linalg.eigh((left + left.T) / 2)
    some = values > max(DROPPED * max(yy[new, new].diagonal().max(), 0), 1e-16)
    scaled = vectors[:, some] / np.sqrt(values[some])
    turn = np.concatenate([-along @ scaled, np.zeros((qq.shape[0] - width, scaled.shape[1])), scaled])
    if not turn.shape[1]:
        residual = 0.0  # the kernel maps the basis into itself
    return {"theta": theta, "ritz": ritz, "turn": turn, "residual": residual, "restart": False}


def _solved(state: DataFrame, group: str, wanted: int, depth: int, tolerance: float) -> DataFrame:
    kind = dict(state.dtypes)[group]
    widths = state.groupBy(group).agg(F.max("newest").alias("newest"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        n = int(frame["width"].iloc[0])
        found = small_problem(*np.sum(frame["sums"].tolist(), axis=0).reshape(3, n, n), int(frame["newest"].iloc[0]), wanted, depth, tolerance)
        row = {group: frame[group].iloc[0], **{c: found[c].ravel().tolist() for c in ("theta", "ritz", "turn")}, "residual": found["residual"], "restart": found["restart"]}
        return pd.DataFrame([row])

    return _inner_products(state, group).join(widths, group).groupBy(group).applyInPandas(one, f"{group} {kind}, {SMALL}")


def _rows(df: DataFrame, schema: str, fn) -> DataFrame:
    """``fn`` on batches of rows of one group each, whose arrays have one width."""
    group = df.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(group).to_pandas()
            for rows in names.groupby(names).indices.values():
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *fn(part, lambda c, p=part: p.column(c).flatten().to_numpy().reshape(p.num_rows, -1), lambda c, p=part: p.column(c)[0].values.to_numpy())], names=[x.split()[0] for x in schema.split(", ")])

    return df.mapInArrow(run, schema)


def leading_pairs(base: DataFrame, group: str, ident: str, k: int, *, depth: int = 6, tolerance: float = 1e-7, most_steps: int = 120, block: int = kernels.BLOCK) -> tuple[DataFrame, DataFrame]:
    """(group, ident, u: its entries of the leading k + 1 eigenvectors), (group, lam: their eigenvalues, descending), of the symmetric
    kernel of points from ``kernels.degrees``; fewer where a group has fewer points.

    Ends when the residuals of all wanted pairs are under ``tolerance``, and with an error after ``most_steps`` multiplications.
    """
    kinds = dict(base.dtypes)
    keys = f"{group} {kinds[group]}, {ident} {kinds[ident]}"
    eps = base.select(group, "eps").distinct()
    draws = F.transform(F.sequence(F.lit(1), F.lit(k + 4)), lambda j: F.pmod(F.xxhash64(j, ident), F.lit(2000001)) / 1000000.0 - 1)
    new = base.select(group, ident, F.concat(F.array(F.sqrt("d")), draws).alias("fresh")).withColumn("q", F.array().cast("array<double>")).withColumn("y", F.array().cast("array<double>"))
    for _ in range(most_steps):
        # images of the newest block; the basis itself stays with its points
        points = base.join(new, [group, ident])
        scale = F.col("weight") / F.sqrt("d")
        fed = kernels.packed(points, group, ident, "vec", F.transform("fresh", lambda x: x * scale), block)
        images = kernels.times(fed, group, eps).select(group, F.col("id").alias(ident), "product")
        state = points.join(images, [group, ident]).select(
            group, ident, F.concat("q", "fresh").alias("q"), F.concat("y", F.transform("product", lambda x: x * scale)).alias("y"), F.size("fresh").alias("newest")
        )
        state = written(state, "krylov")
        small = written(_solved(state, group, k + 1, depth, tolerance), "krylov-small")
        if small.where(F.col("residual") > tolerance).isEmpty():
            return _vectors(state, small, group, ident, keys, k), small.select(group, F.slice("theta", 1, k + 1).alias("lam"))

        def advanced(part, rows, first):
            q, y, turn = rows("q"), rows("y"), first("turn")
            if part.column("restart")[0].as_py():
                return listed(y @ turn.reshape(q.shape[1], -1)), listed(q[:, :0]), listed(q[:, :0])
            return listed(np.concatenate([q, y], axis=1) @ turn.reshape(2 * q.shape[1], -1)), listed(q), listed(y)

        new = _rows(state.join(small.select(group, "turn", "restart"), group).select(group, ident, "q", "y", "turn", "restart"), f"{keys}, fresh array<double>, q array<double>, y array<double>", advanced)
    raise RuntimeError(f"eigenpairs did not settle in {most_steps} steps")


def _vectors(state: DataFrame, small: DataFrame, group: str, ident: str, keys: str, k: int) -> DataFrame:
    """Unit Ritz vectors, signed so that each one's entry of the largest size is positive."""

    def combined(part, rows, first):
        ritz = first("ritz").reshape(rows("q").shape[1], -1)
        return (listed(rows("q") @ ritz[:, : k + 1]),)

    joined = state.join(small.select(group, "ritz"), group).select(group, ident, "q", "ritz")
    u = written(_rows(joined, f"{keys}, u array<double>", combined), "krylov-vectors")
    kind = keys.split(", ")[0]

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[object, np.ndarray] = {}
        for batch in batches:
            names = batch.column(group).to_pandas()
            for name, rows in names.groupby(names).indices.items():
                values = batch.take(pa.array(rows)).column("u").flatten().to_numpy().reshape(len(rows), -1)
                if name in top:
                    values = np.concatenate([top[name][None, :], values])
                top[name] = values[np.abs(values).argmax(0), np.arange(values.shape[1])]
        yield pa.RecordBatch.from_pylist([{group: name, "top": x} for name, x in top.items()], pa.schema([(group, kernels._arrow(kind.split()[1])), ("top", pa.list_(pa.float64()))]))

    tops = u.select(group, "u").mapInArrow(largest, f"{kind}, top array<double>").select(group, F.posexplode("top").alias("p", "x"))
    signs = tops.groupBy(group, "p").agg(F.max_by("x", F.abs("x")).alias("x")).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("p", F.signum("x").alias("s")))).alias("s"))
    return u.join(signs, group).select(group, ident, F.zip_with("u", "s.s", lambda a, b: a * F.when(b < 0, -1.0).otherwise(1.0)).alias("u"))


def _gaussian(n: int, seed: int, ident: str) -> Column:
    """``n`` normal numbers drawn from a row's id."""
    def uniform(j: Column, which: int) -> Column:
        return (F.pmod(F.xxhash64(j, F.lit(seed), F.lit(which), F.col(ident)), F.lit(1 << 30)) + 1) / float(1 << 30)

    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.sqrt(-2 * F.log(uniform(j, 0))) * F.cos(2 * math.pi * uniform(j, 1)))


def _power(base: DataFrame, rows: DataFrame, group: str, ident: str, time: int, block: int) -> DataFrame:
    """group, ident, x: the ``time``-th power of the symmetric kernel times the column ``x`` of ``rows``."""
    eps, scale = base.select(group, "eps").distinct(), F.col("weight") / F.sqrt("d")
    for _ in range(time):
        fed = kernels.packed(base.join(rows, [group, ident]), group, ident, "vec", F.transform("x", lambda v: v * scale), block)
        images = kernels.times(fed, group, eps).select(group, F.col("id").alias(ident), F.col("product").alias("x"))
        scales = base.select(group, ident, scale.alias("_scale"))
        rows = written(images.join(scales, [group, ident]).select(group, ident, F.transform("x", lambda v: v * F.col("_scale")).alias("x")), "power")
    return rows


def orthogonal_turn(gram: np.ndarray, known: int, whiten: bool) -> np.ndarray:
    """From the inner products of (Q, Y), with ``known`` orthonormal columns Q: their combination that is Y less its part along Q. With ``whiten`` all of Y but the
    PROBES last columns becomes orthonormal, which may leave fewer columns, and the probes lose their parts along these."""
    along = gram[:known, known:]
    out = np.concatenate([-along, np.eye(len(gram) - known)])
    if not whiten:
        return out
    fresh = len(gram) - known - PROBES
    left = gram[known:, known:] - along.T @ along
    values, vectors = np.linalg.eigh((left + left.T)[:fresh, :fresh] / 2)
    some = values > max(1e-15 * values[-1], 1e-250) if fresh else np.zeros(0, bool)
    turn = vectors[:, some] / np.sqrt(values[some])
    basis = out[:, :fresh] @ turn
    return np.concatenate([basis, out[:, fresh:] - basis @ (turn.T @ left[:fresh, fresh:])], axis=1)


def _whole(blocks: DataFrame, group: str, told: Column | str) -> DataFrame:
    """Blocks as ``kernels`` reads them, each by itself."""
    return blocks.select(group, F.lit(0).alias("tile"), F.col("block").alias("col"), "ids", "x", "extra", exprs.col(told).cast("array<double>").alias("told"))


def _turned(blocks: DataFrame, group: str, whiten: bool) -> DataFrame:
    """Blocks of points with Q as vectors and Y as further numbers, Y turned by ``orthogonal_turn``. Inner products are added up over tasks; a block carries its turn once."""
    kinds = dict(blocks.dtypes)
    kind = kernels._arrow(kinds[group])

    def both(b: kernels.Block) -> np.ndarray:
        return np.concatenate([b.x, b.extra], axis=1)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[object, tuple[int, np.ndarray]] = {}
        for (name, _, _), b in kernels._read(batches, group):
            sums = both(b).T @ both(b)
            total[name] = (b.x.shape[1], total[name][1] + sums if name in total else sums)
        for name, (known, sums) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name], kind), pa.array([known], pa.int32()), listed(sums.reshape(1, -1))], names=[group, "known", "sums"])

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        sums = np.sum(frame["sums"].tolist(), axis=0)
        turn = orthogonal_turn(sums.reshape(math.isqrt(len(sums)), -1), int(frame["known"].iloc[0]), whiten)
        return pd.DataFrame([{group: frame[group].iloc[0], "told": turn.ravel().tolist()}])

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, _, col), b in kernels._read(batches, group):
            y = both(b) @ b.told.reshape(b.x.shape[1] + b.extra.shape[1], -1)
            ids = pa.ListArray.from_arrays(pa.array([0, len(b.ids)], pa.int32()), b.ids)
            yield pa.RecordBatch.from_arrays([pa.array([name], kind), pa.array([col], pa.int32()), ids, listed(b.x.reshape(1, -1)), listed(y.reshape(1, -1))], names=[group, "block", "ids", "x", "extra"])

    sums = _whole(blocks, group, F.array()).mapInArrow(products, f"{group} {kinds[group]}, known int, sums array<double>")
    turns = written(sums.groupBy(group).applyInPandas(one, f"{group} {kinds[group]}, told array<double>"), "turn")
    return written(_whole(blocks.join(turns, group), group, "told").mapInArrow(turned, f"{group} {kinds[group]}, block int, ids {kinds['ids']}, x array<double>, extra array<double>"), "turned")


def _unpacked(blocks: DataFrame, group: str, ident: str) -> DataFrame:
    """group, ident, y: the further numbers of each point of the blocks."""
    kinds = dict(blocks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, _, _), b in kernels._read(batches, group):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(b.ids), kernels._arrow(kinds[group])), b.ids, listed(b.extra)], names=[group, ident, "y"])

    return _whole(blocks, group, F.array()).mapInArrow(run, f"{group} {kinds[group]}, {ident} {kinds['ids'][6:-1]}, y array<double>")


def power_coordinates(base: DataFrame, group: str, ident: str, time: int, *, tolerance: float = 1e-12, first: int = 32, block: int = kernels.BLOCK) -> DataFrame:
    """group, ident, psi: coordinates whose squared distances are the diffusion distances at a whole ``time``, all pairs but the trivial one together, to ``tolerance``.

    The distance of two points is that of their columns in A, the power ``time`` of the kernel of points from ``kernels.degrees`` without its trivial pair. A times ``first``
    random vectors gives an orthonormal basis Q, and AQ the coordinates: squared distances fall short by at most twice the square of the norm of A - QQ'A, which
    random probes tell. Groups where that is over ``tolerance`` go on with more vectors, as often as it takes; a basis of all directions leaves nothing.
    """
    nothing, done = F.array().cast("array<double>"), []
    sums = base.groupBy(group).agg(F.sum("d").alias("_sum"))
    known = base.join(sums, group).select(group, ident, F.array(F.sqrt(F.col("d") / F.col("_sum"))).alias("q"), nothing.alias("psi"))
    for turn in itertools.count():
        drawn = base.select(group, ident, _gaussian((first << turn) + PROBES, turn, ident).alias("x"))
        images = _power(base, drawn, group, ident, time, block).withColumnRenamed("x", "y")
        blocks = kernels.packed(known.select(group, ident, "q").join(images, [group, ident]), group, ident, "q", F.col("y"), block)
        for whiten in (False, True, True):  # twice, as the first basis of unlike directions is orthonormal to few digits
            blocks = _turned(blocks, group, whiten)
        state = _unpacked(blocks, group, ident)
        size = F.size("y") - PROBES
        fresh = state.select(group, ident, F.slice("y", F.lit(1), size).alias("x"))
        probed = F.slice("y", size + 1, F.lit(PROBES))
        left = written(state.groupBy(group).agg((2 * UNSURE / PROBES * F.sum(exprs.energy(probed))).alias("left"), F.count("*").alias("n")), "left")
        more = _power(base, fresh, group, ident, time, block).withColumnRenamed("x", "_more")
        known = known.join(fresh, [group, ident]).join(more, [group, ident])
        known = written(known.select(group, ident, F.concat("q", "x").alias("q"), F.concat("psi", "_more").alias("psi")), "known")
        unsettled = left.where(~(F.col("left") <= tolerance))
        done.append(known.join(unsettled, group, "left_anti").select(group, ident, "psi"))
        if unsettled.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)
        if not unsettled.where(F.col("n") < first << turn).isEmpty():
            raise RuntimeError("a basis of all directions leaves something: vectors must be finite")
        known, base = (df.join(unsettled, group, "left_semi") for df in (known, base))
