"""Diffusion maps, one layer in a task or, for layers of very many points, by products with a kernel in blocks; distances between embeddings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaprobe.functions import exprs
from tessaprobe.operators import kernels, spectra
from tessaprobe.operators.kernels import FLOAT_EPS
from tessaprobe.operators.sampling import latest_wins, numbered
from tessaprobe.sources.shared import written


def diffusion_arrays(x: np.ndarray, cutoff: float, time: float, alpha: float, k: int | None) -> dict:
    """One group's map: kept coordinates, complement, eigenvalues, mixing constant. Signs: each column's largest entry is positive."""
    sq = (x * x).sum(1)
    d2 = np.maximum(0, sq[:, None] + sq[None, :] - 2 * x @ x.T)
    np.fill_diagonal(d2, 0)
    upper = np.sort(d2[np.triu_indices(len(x), 1)])
    eps = max(upper[(len(upper) - 1) // 2] if len(upper) else 0.0, FLOAT_EPS)
    kern = np.exp(-d2 / (2 * eps))
    d = kern.sum(1)
    if alpha:
        kern = kern * np.power(d, -alpha)[:, None] * np.power(d, -alpha)[None, :]
        d = kern.sum(1)
    c_value = 1 / np.sqrt(d.min() / d.sum()) / np.log(2)
    root = 1 / np.sqrt(np.maximum(d, FLOAT_EPS))
    values, vectors = np.linalg.eigh(kern * root[:, None] * root[None, :])
    values, vectors = values[::-1], vectors[:, ::-1]
    if k is not None:
        values, vectors = values[: k + 1], vectors[:, : k + 1]
    lam, psi = values[1:], vectors[:, 1:]
    if psi.shape[1]:
        psi = psi * np.sign(psi[np.abs(psi).argmax(0), np.arange(psi.shape[1])] + 1e-300)
    running = np.cumsum(lam)
    kept = int((running / max(running[-1], FLOAT_EPS) < cutoff).sum()) + 1 if len(lam) else 0
    with np.errstate(invalid="ignore"):
        scaled = psi * np.power(lam, time)
    return {"psi": scaled[:, :kept], "rest": scaled[:, kept:], "lam": lam, "c": float(c_value)}


SOLVERS = ("full", "krylov")


def diffusion_map(
    points: DataFrame, group: str, keys: Sequence[str], vec: str, *, cutoff: float = 0.99, time: float = 10.0, alpha: float = 0.0, k: int | None = None, solver: str = "full"
) -> DataFrame:
    """group, keys, n_components, psi, complement, eigenvalues, c_value: each group's eigenproblem is one task's work."""
    if solver not in SOLVERS:
        raise ValueError(f"unknown solver {solver!r}, one of {SOLVERS}")
    if solver == "krylov":
        return diffusion_map_krylov(points, group, keys, vec, cutoff=cutoff, time=time, alpha=alpha, k=k or 50)
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    names = [group, *keys]
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", n_components int, psi array<double>, complement array<double>, eigenvalues array<double>, c_value double"

    def one(frame):
        frame = frame.sort_values(list(keys)).reset_index(drop=True)
        got = diffusion_arrays(np.array(frame[vec].tolist(), np.float64), cutoff, time, alpha, k)
        out = frame[names].assign(n_components=got["psi"].shape[1])
        out["psi"], out["complement"] = list(got["psi"]), list(got["rest"])
        out["eigenvalues"] = [got["lam"]] * len(out)
        out["c_value"] = got["c"]
        return out

    return points.groupBy(group).applyInPandas(one, schema)


def diffusion_map_krylov(points: DataFrame, group: str, keys: Sequence[str], vec: str, *, cutoff: float, time: float, alpha: float, k: int) -> DataFrame:
    """For groups with too many points for a task each: the k leading pairs beside the trivial one by products with a kernel that is never
    stored; the complement holds what of these k the cutoff leaves. Null groups and keys are not allowed."""
    number = written(numbered(points, list(keys), "_id").select(group, *keys, "_id", vec), "numbered")
    base = kernels.degrees(number, group, "_id", vec, alpha)
    vectors, values = spectra.leading_pairs(base, group, "_id", k)
    lam = F.slice("lam", 2, k)
    running = F.transform(F.sequence(F.lit(1), F.size(lam)), lambda i: F.aggregate(F.slice(lam, F.lit(1), i), F.lit(0.0), lambda a, x: a + x))
    whole = F.greatest(F.element_at(running, -1), F.lit(FLOAT_EPS))
    kept = F.when(F.size("lam") > 1, F.size(F.filter(running, lambda x: x / whole < cutoff)) + 1).otherwise(0)
    told = values.select(group, lam.alias("eigenvalues"), kept.alias("n_components")).join(kernels.mixing_constant(base, group), group)
    scaled = F.zip_with(F.slice("u", 2, k), "eigenvalues", lambda u, x: u * F.pow(x, F.lit(float(time))))
    return number.join(vectors, [group, "_id"]).join(told, group).withColumn("_all", scaled).select(
        group, *keys, "n_components", F.slice("_all", F.lit(1), F.col("n_components")).alias("psi"),
        F.slice("_all", F.col("n_components") + 1, F.size("_all")).alias("complement"), "eigenvalues", "c_value",
    )


FULL_MOST = 2000  # points of a group whose map is one task's: its matrices and coordinates then take about 0.3 GB


def by_size(points: DataFrame, group: str, most: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Points of the groups with up to ``most`` points, and of the larger ones; None where there is no such group."""
    sizes = points.groupBy(group).agg(F.count("*").alias("_n"))
    large = sizes.where(F.col("_n") > most).select(group)
    found = large.count()
    if not found:
        return points, None
    small = None if found == sizes.count() else points.join(large, group, "left_anti")
    return small, points.join(large, group, "left_semi")


def eigenvalue_sums(points: DataFrame, group: str, ident: str, vec: str, most: int | None = None, block: int = kernels.BLOCK) -> DataFrame:
    """group, n, eigen_sum, eigen_squares: sums over the eigenvalues beside the trivial one, 1, and over their squares.

    A group with up to ``most`` (FULL_MOST) points is solved in a task. Of a larger one no task could hold the matrix: there the sums
    are its trace and its squared norm, which are added up block by block, less that 1. They are the same numbers.
    """
    small, large = by_size(points, group, FULL_MOST if most is None else most)
    parts = []
    if small is not None:
        full = diffusion_map(small, group, [ident], vec, cutoff=0.99, time=1.0)
        one = full.groupBy(group).agg(F.count("*").cast("int").alias("n"), F.first("eigenvalues").alias("e"))
        parts.append(one.select(group, "n", exprs.total("e").alias("eigen_sum"), exprs.energy("e").alias("eigen_squares")))
    if large is not None:
        base = kernels.degrees(large, group, ident, vec, block=block)
        rows = kernels.times(kernels.scaled_blocks(base, group, ident, block=block), group, base.select(group, "eps").distinct(), squares=True)
        norms = rows.groupBy(group).agg(F.sum(F.col("product")[0]).alias("_norm"))
        sums = base.groupBy(group).agg(F.count("*").cast("int").alias("n"), F.sum(1 / F.col("d")).alias("_trace")).join(norms, group)
        parts.append(sums.select(group, "n", (F.col("_trace") - 1).alias("eigen_sum"), (F.col("_norm") - 1).alias("eigen_squares")))
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


def psi_distances(points: DataFrame, group: str, ident: str, vec: str, most: int | None = None, block: int = kernels.BLOCK, finish: kernels.Finish | None = None) -> DataFrame:
    """group, i, j (i < j), dist2: squared distances between diffusion coordinates at time 1 with all components.

    A group with up to ``most`` (FULL_MOST) points is solved in a task, and its coordinates are compared. A larger one has n^2 coordinates, and its
    eigenproblem fits no task: there the same distances come from the products of the kernel (``kernels.diffusion_distance_one``).
    """
    small, large = by_size(points, group, FULL_MOST if most is None else most)
    parts = []
    if small is not None:
        full = diffusion_map(small, group, [ident], vec, cutoff=2.0, time=1.0).select(group, ident, "psi")
        parts.append(kernels.distances(full, group, ident, "psi", block, finish).withColumnRenamed("d2", "dist2"))
    if large is not None:
        parts.append(kernels.diffusion_distance_one(large, group, ident, vec, block, finish))
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


def power_distances(points: DataFrame, group: str, ident: str, vec: str, time: int, block: int = kernels.BLOCK, finish: kernels.Finish | None = None) -> DataFrame:
    """group, i, j (i < j), dist2: squared diffusion distances at a whole ``time`` with all components, for groups of any size and spectrum."""
    psi = spectra.power_coordinates(kernels.degrees(points, group, ident, vec, block=block), group, ident, time, block=block)
    return kernels.distances(psi, group, ident, "psi", block, finish).withColumnRenamed("d2", "dist2")


def energy_cutoff(values: DataFrame, keys: Sequence[str], order: Column | str, value: str, cutoff: float) -> DataFrame:
    """keys, n_components: how many leading values stay below the share of the sum, plus one."""
    w = Window.partitionBy(*keys)
    running = F.sum(value).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = running / F.greatest(F.sum(value).over(w), F.lit(FLOAT_EPS))
    return values.withColumn("_s", share).groupBy(*keys).agg((F.count_if(F.col("_s") < cutoff) + 1).alias("n_components"))


def distance_from_reference(psi: DataFrame, keys: Sequence[str] = ("layer",), level: str = "snr", reference: float | None = None, order: str = "noise_name") -> DataFrame:
    """``dist``: from each row's vector to that of its keys at the reference level (the largest by default); null if missing.

    With several reference rows of one key the last in ``order`` counts.
    """
    ref = reference if reference is not None else psi.agg(F.max(level)).first()[0]
    ends = latest_wins(psi.where(F.col(level) == F.lit(ref)), keys, order).select(*keys, F.col("psi").alias("_ref"))
    return psi.join(ends, list(keys), "left").withColumn("dist", exprs.l2("psi", "_ref")).drop("_ref")


def layer_distances(psi: DataFrame, level: str = "snr", layer: str = "layer", order: str = "noise_name") -> DataFrame:
    """level, layer_i, layer_j, dist for all pairs of layers at every level; null where a layer is missing."""
    one = latest_wins(psi, [level, layer], order).select(level, layer, "psi")
    levels, layers = psi.select(level).distinct(), psi.select(layer).distinct()
    grid = levels.crossJoin(layers.withColumnRenamed(layer, "layer_i")).crossJoin(layers.withColumnRenamed(layer, "layer_j"))  # dimensions, the result
    a = one.select(level, F.col(layer).alias("layer_i"), F.col("psi").alias("_a"))
    b = one.select(level, F.col(layer).alias("layer_j"), F.col("psi").alias("_b"))
    return grid.join(a, [level, "layer_i"], "left").join(b, [level, "layer_j"], "left").select(level, "layer_i", "layer_j", exprs.l2("_a", "_b").alias("dist"))
