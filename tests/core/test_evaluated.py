import numpy as np

from tessaprobe.plans import jobs, registry


def si_sdr(x, y):
    g = np.dot(x, y) / np.dot(x, x)
    return 10 * np.log10(np.sum((g * x) ** 2) / np.sum((y - g * x) ** 2))


def test_manifest_is_scored_on_both_sides(spark):
    rng = np.random.default_rng(3)
    clean = {u: rng.normal(size=50) for u in "ab"}
    files = [("a", "r0", "a0"), ("a", "r1", "a1"), ("b", "r1", "b1")]
    noisy = {f: np.append(clean[u], 0.0) + rng.normal(size=51) for u, _, f in files}
    better = {f: clean[u][:40] + 0.1 * rng.normal(size=40) for u, _, f in files}
    manifest = spark.createDataFrame([(u, r, 0.5, 7.0, f) for u, r, f in files], "utterance_id string, rir_id string, rt60 double, c50 double, filepath string")

    def waves(found, key):
        return spark.createDataFrame([(k, v.tolist()) for k, v in found.items()], f"{key} string, samples array<double>")

    out = jobs.evaluated(manifest, waves(noisy, "filepath"), waves(better, "filepath"), waves(clean, "utterance_id"), "reverb", {"pesq": lambda x, y: len(x) + y[0]})
    got = {(r.utterance_id, r.rir_id): r for r in out.collect()}
    assert len(got) == 3
    for u, r, f in files:
        row = got[u, r]
        assert (row.domain, row.rt60, row.c50, row.stoi) == ("reverb", 0.5, 7.0, None)
        assert abs(row.si_sdr - si_sdr(clean[u][:40], better[f])) < 1e-6 and abs(row.si_sdr_input - si_sdr(clean[u][:40], noisy[f][:40])) < 1e-6
        assert row.pesq == 40 + better[f][0] and row.pesq_input == 40 + noisy[f][0]
    summary, bins = jobs.evaluation_report(out)
    assert summary.first().n == 3 and bins.first().n == 3


def test_appended_domains_over_its_own_rows(spark, tmp_path):
    """The query runs, and its second domain has no scores but si_sdr."""
    rows = [(1, 17, "F", 30000.0), (2, 5, "F", 60000.0), (3, 6, "O", 90000.0)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.domain: (r.n, r.n_pesq, r.n_si_sdr, r.n_stoi, r.pesq) for r in registry.queries()["appended_domains"](spark, str(tmp_path)).collect()}
    assert got == {"F": (2, 2, 2, 0, 0.2), "F_again": (2, 0, 2, 0, None), "O": (1, 1, 1, 0, 1.6), "O_again": (1, 0, 1, 0, None)}
