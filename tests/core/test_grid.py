"""A model's rows of both kinds from one pass, and similarity against clean rows that are held once."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tessaprobe.operators import represent, signal
from tessaprobe.plans import grid

ROWS = "utt_id string, noise_name string, level double, layer string, token_idx int, vec array<double>"


def pooled(seed, utts, conditions, tokens=6, width=4):
    rng = np.random.default_rng(seed)
    return [(u, *c, layer, t, rng.normal(size=width).tolist()) for u in utts for c in [(None, None), *conditions] for layer in ("a", "b") for t in range(tokens)]


def test_every_condition_meets_the_clean_rows(spark, monkeypatch):
    rows = pooled(1, ["u", "v", None], [("n", 0.0), ("n", 5.0), ("m", 0.0), ("m", None)])
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # matrices cross batches
    try:
        got = {(r.utt_id, r.noise_name, r.level, r.layer): r.CKA for r in represent.cka_of_conditions(df, ["utt_id", "layer"], ["noise_name", "level"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    matrices = {}
    for u, n, lv, layer, _, vec in rows:
        matrices.setdefault((u, n, lv, layer), []).append(vec)
    want = {k: represent.linear_cka(np.array(matrices[k[0], None, None, k[3]]), np.array(v)) for k, v in matrices.items() if k[1] is not None}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("change", ["token", "width", "clean"])
def test_other_shapes_are_an_error(spark, change):
    rows = pooled(2, ["u"], [("n", 0.0)])
    if change == "token":
        rows = rows[:-1]
    elif change == "width":
        rows[-1] = (*rows[-1][:5], [1.0])
    else:
        rows = [r for r in rows if r[1] is not None]
    with pytest.raises(Exception, match="differ in shape"):
        represent.cka_of_conditions(spark.createDataFrame(rows, ROWS), ["utt_id", "layer"], ["noise_name", "level"]).collect()


def test_a_model_is_called_once_per_wave(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(frame):
        calls.add(len(frame))
        rows = pd.DataFrame({"utt_id": frame["utt_id"], "layer": "l", "shape": [[len(x), 1] for x in frame["samples"]]})
        return rows[[len(x) > 1 for x in frame["samples"]]], frame[["utt_id"]].assign(enhanced=[None if len(x) == 3 else [*x, 7.0, 7.0] for x in frame["samples"]])

    waves = spark.createDataFrame([(f"u{i}", [float(i)] * i) for i in range(1, 9)], "utt_id string, samples array<double>")
    rows, enhanced = represent.extract_with_enhanced(waves, model, "utt_id string, layer string, shape array<int>", ["utt_id"])
    found = {r.utt_id: r.enhanced for r in enhanced.collect()}
    assert {r.utt_id: r["shape"] for r in rows.collect()} == {f"u{i}": [i, 1] for i in range(2, 9)}
    assert found == {f"u{i}": None if i == 3 else [float(i)] * i for i in range(1, 9)}
    assert calls.value == 8
    with pytest.raises(Exception, match="enhanced signals of"):
        represent.extract_with_enhanced(waves, lambda f: (f[["utt_id"]], f[["utt_id"]].assign(enhanced=None)[:0]), "utt_id string", ["utt_id"])


def test_both_sides_are_scored_in_one_pass(spark):
    calls = spark.sparkContext.accumulator(0)

    def scorer(x, y):
        calls.add(1)
        return float(np.abs(x - y).sum())

    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [1.0, 3.0], [0.0, 2.0, 3.0, 4.0]), (2, [1.0], [1.0], [2.0])], "k int, c array<double>, n array<double>, e array<double>")
    scored = signal.score_sides(df, {"gap": scorer}, "c", {"n": "noisy_{}", "e": "enhanced_{}"})
    got = {r.k: r for r in scored.collect()}
    assert (got[1].noisy_gap, got[1].enhanced_gap, got[2].enhanced_gap, got[1].e) == (1.0, 1.0, 1.0, [0.0, 2.0])
    assert calls.value == 4 and scored._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1


def test_sums_of_very_many_keys_are_not_kept():
    """Rows in order with keys across batches, and rows in any order: the sums per key, most of them added up together."""
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(0, 3000, 9000))
    vecs = rng.normal(size=(9000, 2))
    want = {int(k): vecs[keys == k].sum(0) for k in np.unique(keys)}
    for ordered in (True, False):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + 4100]), pa.array(vecs[a : a + 4100].tolist()), pa.array([1] * len(keys[a : a + 4100]))], names=["k", "sum", "n"]) for a in range(0, 9000, 4100)]
        rows = [r for b in represent._added(iter(batches), ["k"], ordered) for r in b.to_pylist()]
        got = {}
        for r in rows:
            got[r["k"]] = got.get(r["k"], 0) + np.array(r["sum"])
        assert sum(r["n"] for r in rows) == 9000 and got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
        assert not ordered or len(rows) == len(want)
    out = list(represent._added(iter(batches), ["k"], True))
    assert max(b.num_rows for b in out) > 1000


def test_tokens_of_a_batch_are_one_frame(monkeypatch):
    frame = pd.DataFrame({"utt_id": [1, 2, 3], "samples": [np.arange(9.0), np.arange(3.0), np.arange(8.0)]})
    monkeypatch.setattr(grid, "SAMPLES_AT_ONCE", 100)
    (got,) = grid.grid_tokens([frame])
    assert got.columns.tolist() == ["utt_id", "layer", "call_idx", "time_idx", "token_idx", "vec"] and len(got) == 8
    assert got[(got.utt_id == 3) & (got.layer == "square") & (got.time_idx == 1)].vec.iloc[0].tolist() == [16.0, 25.0, 36.0, 49.0]
