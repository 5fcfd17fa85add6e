import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessaprobe.operators import kernels, manifold, represent, spectra


def points(spark, x, layer="a"):
    return spark.createDataFrame([(layer, i, [float(v) for v in row]) for i, row in enumerate(x)], "layer string, i int, vec array<double>")


def rows(spark, x, **options):
    got = manifold.diffusion_map(points(spark, x), "layer", ["i"], "vec", **options).orderBy("i").collect()
    return got, np.array([r.psi for r in got]), np.array(got[0].eigenvalues)


def test_shapes_order_and_determinism(spark):
    x = np.random.default_rng(0).normal(size=(50, 20))
    got, psi, lam = rows(spark, x)
    assert psi.shape == (50, got[0].n_components) and len(lam) == 49
    assert np.all(np.diff(lam) <= 1e-9) and lam.min() > -1e-6 and lam.max() < 1 + 1e-6
    assert np.array_equal(psi, rows(spark, x)[1])
    assert {len(r.psi) + len(r.complement) for r in got} == {49}


def test_cutoff_time_alpha_and_k(spark):
    x = np.random.default_rng(1).normal(size=(20, 10))
    n = [rows(spark, x, cutoff=c)[0][0].n_components for c in (0.5, 0.9, 0.99)]
    assert n == sorted(n) and n[0] < n[-1]
    assert not np.allclose(rows(spark, x, time=1.0)[1][:, 0], rows(spark, x, time=3.0)[1][:, 0])
    assert np.isfinite(rows(spark, x, alpha=0.5)[1]).all()
    assert rows(spark, x, k=4)[1].shape[1] <= 4
    with pytest.raises(ValueError):
        manifold.diffusion_map(points(spark, x), "layer", ["i"], "vec", solver="other")


def test_degenerate_points(spark):
    assert np.isfinite(rows(spark, np.ones((10, 4)))[1]).all()
    assert np.isfinite(rows(spark, np.random.default_rng(2).normal(size=(30, 1)))[1]).all()


def test_distance_identity_at_time_one(spark):
    x = np.random.default_rng(3).normal(size=(25, 6))
    p = points(spark, x)
    full = manifold.diffusion_map(p, "layer", ["i"], "vec", cutoff=2.0, time=1.0).orderBy("i").collect()
    psi = np.array([list(r.psi) + list(r.complement) for r in full])
    found = kernels.diffusion_distance_one(p, "layer", "i", "vec", block=7).collect()
    assert len(found) == 25 * 24 // 2
    for r in found:
        assert abs(r.dist2 - np.sum((psi[r.i] - psi[r.j]) ** 2)) < 1e-9
    c = kernels.mixing_constant(kernels.degrees(p, "layer", "i", "vec", block=7), "layer").first().c_value
    assert abs(c - full[0].c_value) < 1e-9


def test_large_groups_have_no_map_in_a_task(spark, monkeypatch):
    """Groups above the size are not solved, the others are; both give what numpy's eigenvalues and coordinates give."""
    rng = np.random.default_rng(9)
    groups = {"small": rng.normal(size=(20, 4)), "large": rng.normal(size=(45, 4))}
    p = spark.createDataFrame([(g, i, v.tolist()) for g, x in groups.items() for i, v in enumerate(x)], "layer string, i int, vec array<double>")
    want = {g: manifold.diffusion_arrays(x, 2.0, 1.0, 0.0, None) for g, x in groups.items()}
    solved, real = [], manifold.diffusion_map
    monkeypatch.setattr(manifold, "diffusion_map", lambda points, *a, **k: (solved.append(sorted(r.layer for r in points.select("layer").distinct().collect())), real(points, *a, **k))[1])
    for most, kept in ((30, [["small"]]), (50, [["large", "small"]]), (10, [])):
        solved.clear()
        sums = {r.layer: r for r in manifold.eigenvalue_sums(p, "layer", "i", "vec", most, block=7).collect()}
        assert solved == kept and {g: r.n for g, r in sums.items()} == {"small": 20, "large": 45}
        for g, r in sums.items():
            assert abs(r.eigen_sum - want[g]["lam"].sum()) < 1e-9 and abs(r.eigen_squares - (want[g]["lam"] ** 2).sum()) < 1e-9
        solved.clear()
        dist = manifold.psi_distances(p, "layer", "i", "vec", most, block=7).collect()
        assert solved == kept and len({(r.layer, r.i, r.j) for r in dist}) == len(dist) == 20 * 19 // 2 + 45 * 44 // 2
        assert all(abs(r.dist2 - np.sum((want[r.layer]["psi"][r.i] - want[r.layer]["psi"][r.j]) ** 2)) < 1e-9 for r in dist)


def test_krylov_solver_gives_the_same_pairs(spark):
    """Groups of unlike size and spectrum, one with fewer points than pairs; alpha; the matrix is never stored."""
    rng = np.random.default_rng(8)
    rows = [(g, i, x.tolist()) for g, (n, d) in enumerate([(70, 3), (60, 40), (4, 2)]) for i, x in enumerate(rng.normal(size=(n, d)) * (g + 1))]
    p = spark.createDataFrame(rows, "layer int, i int, vec array<double>")
    for alpha, k in ((0.0, 6), (0.5, 5)):
        full = {(r.layer, r.i): r for r in manifold.diffusion_map(p, "layer", ["i"], "vec", k=k, time=1.0, alpha=alpha).collect()}
        got = manifold.diffusion_map(p, "layer", ["i"], "vec", k=k, time=1.0, alpha=alpha, solver="krylov").collect()
        assert len(got) == len(full)
        for r in got:
            want = full[r.layer, r.i]
            assert np.allclose(r.eigenvalues, want.eigenvalues, atol=1e-6) and abs(r.c_value - want.c_value) < 1e-9 and r.n_components == want.n_components
            assert np.allclose(np.abs([*r.psi, *r.complement]), np.abs([*want.psi, *want.complement]), atol=1e-5)


def test_power_distances_of_any_spectrum(spark):
    """More far points than a first basis has directions (their eigenvalues are all 1), spectra with a gap and without, one point, two, equal ones, clusters: all pairs as powers of the kernel give them."""
    rng = np.random.default_rng(12)
    groups = {
        "far": np.concatenate([rng.normal(size=(170, 5)), 30.0 * rng.normal(size=(60, 5))]), "flat": rng.normal(size=(90, 64)), "low": rng.normal(size=(80, 2)), "one": np.ones((1, 3)),
        "two": np.array([[0.0, 1], [2, 3]]), "same": np.ones((40, 3)), "later": np.concatenate([np.zeros((60, 3)), np.repeat(np.eye(6), 10, 0) * 9 + rng.normal(size=(60, 6)) / 9], axis=1),
    }
    p = spark.createDataFrame([(g, i, v.tolist()) for g, x in groups.items() for i, v in enumerate(x)], "layer string, i int, vec array<double>")
    got = {(r.layer, r.i, r.j): r.dist2 for r in manifold.power_distances(p, "layer", "i", "vec", 4, block=30).collect()}
    assert len(got) == sum(len(x) * (len(x) - 1) // 2 for x in groups.values())
    for g, x in groups.items():
        d2 = ((x[:, None] - x[None, :]) ** 2).sum(2)
        upper = np.sort(d2[np.triu_indices(len(x), 1)])
        kern = np.exp(-d2 / (2 * max(upper[(len(upper) - 1) // 2] if len(upper) else 0.0, kernels.FLOAT_EPS)))
        root = np.sqrt(kern.sum(1))
        rows = np.linalg.matrix_power(kern / np.outer(root, root), 4) - np.outer(root, root) / kern.sum()
        want = {(g, i, j): np.sum((rows[i] - rows[j]) ** 2) for i in range(len(x)) for j in range(i + 1, len(x))}
        assert all(abs(got[k] - v) < 1e-12 for k, v in want.items()), g


def test_turn_takes_out_what_is_known():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(50, 3)))[0]
    y = np.concatenate([rng.normal(size=(50, 2)) @ rng.normal(size=(2, 6)) + q @ rng.normal(size=(3, 6)), rng.normal(size=(50, spectra.PROBES))], axis=1)
    for whiten in (False, True, True):
        x = np.concatenate([q, y], axis=1)
        y = x @ spectra.orthogonal_turn(x.T @ x, 3, whiten)
    basis, probes = y[:, : -spectra.PROBES], y[:, -spectra.PROBES :]
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-12) and 2 <= basis.shape[1] <= 6
    assert max(np.abs(q.T @ y).max(), np.abs(basis.T @ probes).max()) < 1e-12


def test_small_problem_settles_and_restarts():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(30, 30))
    m = m @ m.T / 60
    q = np.linalg.qr(rng.normal(size=(30, 6)))[0]
    y = m @ q
    one = spectra.small_problem(q.T @ q, q.T @ y, y.T @ y, 6, 2, 5, 1e-9)
    assert not one["restart"] and one["turn"].shape[0] == 12
    fresh = np.concatenate([q, y], axis=1) @ one["turn"]
    assert np.abs(q.T @ fresh).max() < 1e-9 and np.allclose(fresh.T @ fresh, np.eye(fresh.shape[1]))
    assert spectra.small_problem(q.T @ q, q.T @ y, y.T @ y, 6, 2, 1, 1e-9)["restart"]
    exact = np.linalg.eigh(m)[1][:, -6:]
    y = m @ exact
    done = spectra.small_problem(exact.T @ exact, exact.T @ y, y.T @ y, 6, 2, 5, 1e-6)
    assert done["residual"] == 0 and not done["turn"].size and np.allclose(done["theta"][:6], np.linalg.eigvalsh(m)[::-1][:6])


def test_blocked_distances(spark):
    x = np.random.default_rng(5).normal(size=(60, 8))
    got = {(r.i, r.j): r.d2 for r in kernels.distances(points(spark, x), "layer", "i", "vec", block=16).collect()}
    assert set(got) == {(i, j) for i in range(60) for j in range(i + 1, 60)}
    assert all(abs(d - np.sum((x[i] - x[j]) ** 2)) < 1e-9 for (i, j), d in got.items())


def test_bands_and_pieces(spark, monkeypatch):
    """More blocks than bands, pieces smaller than bands, ids of both kinds: every pair once; blocks are shuffled once per band, not per block."""
    monkeypatch.setattr(kernels, "BANDS", 3)
    monkeypatch.setattr(kernels, "BLOCK", 5)
    monkeypatch.setattr(kernels, "TILE_BLOCKS", 8)
    x = np.random.default_rng(11).normal(size=(60, 3))
    p = points(spark, x)
    assert kernels.row_blocks(kernels.packed(p, "layer", "i", "vec", block=2).withColumn("told", F.array(F.lit(0.0))), "layer", half=True)[1].count() <= 30 * 3
    named = p.withColumn("i", F.format_string("%02d", "i"))
    d2 = ((x[:, None] - x[None, :]) ** 2).sum(2)
    for q in (p, named):
        got = {(int(r.i), int(r.j)): r.d2 for r in kernels.distances(q, "layer", "i", "vec", block=2, finish=kernels.half_up(6)).collect()}
        assert set(got) == {(i, j) for i in range(60) for j in range(i + 1, 60)} and all(abs(v - d2[k]) < 6e-7 for k, v in got.items())
    kern = np.exp(d2 / (-2 * np.sort(d2[np.triu_indices(60, 1)])[(60 * 59 // 2 - 1) // 2]))
    m = kern / np.sqrt(np.outer(kern.sum(1), kern.sum(1)))
    found = {(r.i, r.j): r.m for r in kernels.symmetric_pairs(kernels.degrees(p, "layer", "i", "vec", block=2), "layer", "i", block=2).collect()}
    assert len(found) == 3600 and all(abs(v - m[k]) < 1e-12 for k, v in found.items())
    whole = kern.sum()
    got = kernels.diffusion_distance_one(p, "layer", "i", "vec", block=2).collect()
    assert len(got) == len({(r.i, r.j) for r in got}) == 60 * 59 // 2
    for r in got:
        want = np.sum((m[r.i] - m[r.j]) ** 2) - (np.sqrt(kern[r.i].sum()) - np.sqrt(kern[r.j].sum())) ** 2 / whole
        assert r.i < r.j and abs(r.dist2 - want) < 1e-10


def test_pieces_cover_two_bands_once(monkeypatch):
    monkeypatch.setattr(kernels, "BLOCK", 4)
    def band(ids):
        return kernels.Block(0, pa.array(ids), np.array(ids, float)[:, None], np.empty((len(ids), 0)), np.empty(0))

    one, two = band(list(range(10))), band([20, 21, 22])
    for half, col, want in ((False, one, {(i, j) for i in range(10) for j in range(10)}), (True, two, {(i, j) for i in range(10) for j in (20, 21, 22)}), (True, one, {(i, j) for i in range(10) for j in range(i + 1, 10)})):
        seen = []
        for at, a, b in kernels.pieces(one, col, half):
            assert a.x.shape[0] <= 4 and b.x.shape[0] <= 4 and one.ids[at].equals(a.ids)
            if half:
                batch = kernels.ordered_pairs("g", "string", "g", a, b, a.x + b.x.T, "v")
                assert batch.column("v").to_pylist() == [i + j for i, j in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True)]
                seen += zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True)
            else:
                seen += [(i, j) for i in a.ids.to_pylist() for j in b.ids.to_pylist()]
        assert len(seen) == len(want) and set(seen) == want


def test_rounding_in_the_task_is_sqls():
    got = kernels.half_up(6)(np.array([[0.0078125, -0.0078125, -1e-9, 2.5e-6, 1234.5678914]])).tolist()
    assert got == [[0.007813, -0.007813, 0.0, 3e-6, 1234.567891]] and not np.signbit(got[0][2])
    assert kernels.half_up(2, 1000.0)(np.array([1.234567])).tolist() == [1234.57]


def test_degrees_and_symmetric_kernel(spark):
    x = np.random.default_rng(6).normal(size=(40, 5))
    d2 = ((x[:, None] - x[None, :]) ** 2).sum(2)
    eps = np.sort(d2[np.triu_indices(40, 1)])[(40 * 39 // 2 - 1) // 2]
    kern = np.exp(-d2 / (2 * eps))
    for alpha in (0.0, 0.5):
        own = kern * np.power(kern.sum(1), -alpha)[:, None] * np.power(kern.sum(1), -alpha)[None, :]
        base = kernels.degrees(points(spark, x), "layer", "i", "vec", alpha=alpha, block=9)
        assert np.allclose([r.d for r in base.orderBy("i").collect()], own.sum(1))
        m = {(r.i, r.j): r.m for r in kernels.symmetric_pairs(base, "layer", "i", block=9).collect()}
        root = np.sqrt(own.sum(1))
        assert len(m) == 1600 and all(abs(v - own[i, j] / (root[i] * root[j])) < 1e-12 for (i, j), v in m.items())


@pytest.mark.parametrize("bins", [4, 4096])
def test_bandwidth_is_the_lower_median(spark, bins):
    """Also of one point (no pair), equal points, and distances that most pairs share, with an even and an odd number of pairs."""
    rng = np.random.default_rng(2)
    groups = {
        "one": np.zeros((1, 2)), "two": np.array([[0.0, 0], [3, 4]]), "same": np.ones((20, 2)), "two values": np.arange(30)[:, None] % 2 * np.ones((1, 2)),
        "grid": np.round(rng.exponential(size=(90, 2)), 1), "far": np.array([[0.0], [1e-150], [1e150], [2e150]]), "any": rng.normal(size=(150, 7)), "odd": rng.normal(size=(6, 3)),
    }
    rows = [(g, i, x.tolist()) for g, v in groups.items() for i, x in enumerate(v)]
    blocks = kernels.packed(spark.createDataFrame(rows, "layer string, i int, vec array<double>"), "layer", "i", "vec", block=25)
    got = {r.layer: r.eps for r in kernels.bandwidth(blocks, "layer", bins=bins).collect()}
    for g, x in groups.items():
        d2 = np.sort(np.maximum(0, ((x[:, None] - x[None, :]) ** 2).sum(2))[np.triu_indices(len(x), 1)])
        want = max(d2[(len(d2) - 1) // 2] if len(d2) else 0.0, kernels.FLOAT_EPS)
        assert got[g] == pytest.approx(want, rel=1e-9), g


def test_no_table_of_all_pairs(spark):
    """What the passes shuffle and write are blocks and sums: no operator but the streamed one makes rows from pairs."""
    p = points(spark, np.random.default_rng(7).normal(size=(50, 3)))
    plan = kernels.times(kernels.packed(p, "layer", "i", "vec", F.array(F.lit(1.0)), 10), "layer", p.select("layer", F.lit(1.0).alias("eps")).distinct())._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "Window" not in plan and plan.count("MapInArrow") == 1


def test_reference_distance_pads_and_leaves_missing_null(spark):
    psi = spark.createDataFrame(
        [("a", 0.0, "n", [1.0, 2.0]), ("a", 30.0, "n", [1.0]), ("b", 0.0, "n", [float("nan"), 1.0]), ("a", 30.0, "m", [9.0])], "layer string, snr double, noise_name string, psi array<double>"
    )
    got = {(r.layer, r.snr, r.noise_name): r.dist for r in manifold.distance_from_reference(psi).collect()}
    assert got["a", 0.0, "n"] == 2.0 and got["a", 30.0, "n"] == 0.0 and got["b", 0.0, "n"] is None and got["a", 30.0, "m"] == 8.0
    both = {(r.layer_i, r.layer_j): r.dist for r in manifold.layer_distances(psi).where("snr = 30").collect()}
    assert both["a", "a"] == 0.0 and both["a", "b"] is None and len(both) == 4


def test_cka_plans_agree(spark):
    rng = np.random.default_rng(6)
    data = []
    for key in range(3):
        x = rng.normal(size=(12, 5))
        y = x @ rng.normal(size=(5, 5)) if key else x * 3 + 1
        data += [(key, t, x[t].tolist(), y[t].tolist()) for t in range(12)]
    data += [(9, t, [1.0] * 5, rng.normal(size=5).tolist()) for t in range(12)]
    pairs = spark.createDataFrame(data, "k int, token_idx int, x array<double>, y array<double>")
    a, b, c = ({r.k: r.CKA for r in f(pairs, ["k"]).collect()} for f in (represent.cka, represent.cka_relational, represent.cka_moments))
    assert abs(a[0] - 1) < 1e-9 and a[9] == 0.0
    assert all(abs(a[k] - b[k]) < 1e-9 and abs(a[k] - c[k]) < 1e-9 for k in a)


def test_pooling(spark):
    rows = [("l", call, t, tok, [float(call + t + tok), 1.0 * t]) for call in range(3) for t in range(2) for tok in range(2)]
    df = spark.createDataFrame(rows, "layer string, call_idx int, time_idx int, token_idx int, vec array<double>")
    first = {r.token_idx: r.vec for r in represent.pool_first(df, ["layer"]).collect()}
    assert first == {0: [0.5, 0.5], 1: [1.5, 0.5]}
    assert {r.token_idx: r.vec[0] for r in represent.pool_drop_last(df, ["layer"]).collect()} == {0: 1.0, 1: 2.0}
    assert {r.token_idx: r.vec[0] for r in represent.pool_mean_of_means(df, ["layer"]).collect()} == {0: 1.5, 1: 2.5}
    one = df.where("call_idx = 0")
    assert represent.pool_drop_last(one, ["layer"]).count() == 2
    got = represent.pool_with(df, ["layer"], lambda f: f.head(1)[["layer"]].assign(n=len(f)), "layer string, n long").first()
    assert got.n == 12
    raw = spark.createDataFrame([(np.array([1.5, -2], np.float32).tobytes(),), (None,)], "b binary")
    assert [r.v for r in raw.select(represent.decode_f32("b").alias("v")).collect()] == [[1.5, -2.0], None]
    assert represent.centroids(df.withColumn("g", F.lit(1)), ["g"]).first().n_samples == 12


def test_vector_sums_by_task(spark, monkeypatch):
    """Null keys and vectors, floats, few numbers held; a key is shuffled once per task."""
    rng = np.random.default_rng(3)
    rows = [(None if i % 11 == 0 else i % 5, f"s{i % 3}", rng.normal(size=3).tolist() if i % 7 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b string, v array<float>").repartition(4)
    want = {}
    for a, b, v in rows:
        if v is not None:
            want.setdefault((a, b), []).append(np.float32(v).astype(float))
    for held in (1 << 23, 4):
        monkeypatch.setattr(represent, "HELD_NUMBERS", held)
        got = {(r.a, r.b): (r.v, r.n) for r in represent.vector_mean(df, ["a", "b"], "v", "n").collect()}
        assert got.keys() == want.keys()
        assert all(n == len(want[k]) and np.allclose(v, np.mean(want[k], axis=0)) for k, (v, n) in got.items())
    assert represent.vector_mean(df.limit(0), ["a"], "v").collect() == []
    for bad in ([[1.0], [1.0, 2.0]], [[1.0, None], [1.0, 2.0]]):
        with pytest.raises(Exception, match="differ in length|hold nulls"):
            represent.vector_mean(spark.createDataFrame([(1, x) for x in bad], "a int, v array<double>"), ["a"], "v").collect()
