"""Queries without SQL read whole tables."""

import duckdb
import numpy as np

from tessaprobe.plans import registry

EVENTS = "event_id bigint, ts bigint, user_id bigint, value double"


def test_every_response_is_dealt(spark, tmp_path):
    rows = [(10 * u + k, k, u, float(u + 1) if k == 0 else 0.0) for u in range(9) for k in range(4)]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.utt_id: (r.rir_id, r.n) for r in registry.queries()["reverberated"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(9)) and sorted(r for r, _ in got.values()) == list(range(9))


def test_leading_distances_take_whole_vectors(spark, tmp_path):
    """Points that differ in their last numbers only; and in another label more far points than a basis of 32 directions can tell."""
    rng = np.random.default_rng(5)
    late = np.concatenate([np.ones((40, 3)), np.repeat(np.eye(4), 10, 0) * 5 + rng.normal(size=(40, 4)) / 9], axis=1)
    far = np.concatenate([rng.normal(size=(110, 7)), 300 * rng.normal(size=(40, 7))])
    rows = [(1000 * label + i, [float(v) for v in x], label) for label, points in enumerate((late, far)) for i, x in enumerate(points)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {(a, i, j): v for a, i, j, v in con.execute(registry.oracle_sql()["diffusion_leading_distances"]).fetchall()}
    got = {(r.layer, r.i, r.j): r.dist2 for r in registry.queries()["diffusion_leading_distances"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 2e-6 for k, v in want.items())
    same = [v for (layer, i, j), v in want.items() if not layer and (i - 1) // 10 == (j - 1) // 10]
    other = [v for (layer, i, j), v in want.items() if not layer and (i - 1) // 10 != (j - 1) // 10]
    assert len(other) == 600 and min(other) > 1e-5 > 10 * max(same)
