import json
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaprobe.functions import stats
from tessaprobe.operators import evaluation, represent, sampling
from tessaprobe.plans import jobs
from tessaprobe.sources import tables


def wav(path, samples, rate=16000, channels=1):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(b"".join(struct.pack("<h", int(s)) for s in samples))


def facts(spark, model="muse"):
    rng = np.random.default_rng(1)
    rows = [
        (u, float(s), n, "encoder_level1.norm1", float(rng.random()), model, 1.0, 2.0) for s in range(-10, 31, 5) for n in ("TBUS", "DKITCHEN", "OOFFICE") for u in range(20)
    ]
    return spark.createDataFrame(rows, tables.SCHEMAS["cka_snr"])


def reverb(spark):
    rows = [(u, -5 + 2.5 * c, r, "encoder_level1.norm1", 0.5) for c in range(13) for r in ("rir_b", "rir_a") for u in range(20)]
    return spark.createDataFrame(rows, tables.SCHEMAS["cka_reverb"])


def test_subset_builder(spark, tmp_path):
    source = str(tmp_path / "results")
    with pytest.raises(tables.MissingTable, match="cka_snr_muse"):
        jobs.build_subset(spark, source, str(tmp_path / "out"))
    for m in ("muse", "mpsenet", "demucs"):
        facts(spark, m).write.parquet(f"{source}/cka_snr_{m}.parquet")
    with pytest.raises(tables.MissingTable):
        jobs.build_subset(spark, source, str(tmp_path / "out"))
    reverb(spark).write.parquet(f"{source}/cka_reverb_muse.parquet")
    sizes = jobs.build_subset(spark, source, str(tmp_path / "out"), units=7)
    assert set(sizes) == {"cka_snr_muse", "cka_snr_mpsenet", "cka_snr_demucs", "cka_reverb"}
    got = spark.read.parquet(str(tmp_path / "out/cka_snr_muse.parquet"))
    assert {r.noise_name for r in got.select("noise_name").distinct().collect()} == {"TBUS"}
    assert {r["n"] for r in got.groupBy("snr").agg(F.count_distinct("clean_idx").alias("n")).collect()} == {7}
    rev = spark.read.parquet(str(tmp_path / "out/cka_reverb_muse.parquet"))
    assert {r.rir_name for r in rev.select("rir_name").distinct().collect()} == {"rir_a"} and rev.select("target_c50").distinct().count() == 5
    with pytest.raises(tables.OverBudget):
        jobs.build_subset(spark, source, str(tmp_path / "out2"), budget_mb=0.000001)


def test_reading_cleans_and_falls_back(spark, tmp_path):
    path = str(tmp_path / "demo.parquet")
    spark.createDataFrame([(1, float("nan")), (2, 0.5)], "clean_idx bigint, CKA double").write.parquet(path)
    assert tables.resolve_table(spark, str(tmp_path / "full.parquet"), path) == path
    with pytest.raises(tables.MissingTable, match="full.parquet"):
        tables.resolve_table(spark, str(tmp_path / "full.parquet"))
    assert [r.CKA for r in tables.read_table(spark, path, ["clean_idx", "CKA"]).orderBy("clean_idx").collect()] == [None, 0.5]


def test_union_of_models_keeps_their_layers(spark, tmp_path):
    for m in ("muse", "demucs"):
        spark.createDataFrame([(1, 0.0, "n", x, 0.5, "old", 1.0, 1.0) for x in ("a.norm1", "b.conv")], tables.SCHEMAS["cka_snr"]).write.parquet(str(tmp_path / m))
    got = tables.union_models(spark, {m: str(tmp_path / m) for m in ("muse", "demucs")}, ["clean_idx", "snr", "layer", "CKA"])
    assert sorted((r.model_name, r.layer) for r in got.collect()) == [("demucs", "a.norm1"), ("demucs", "b.conv"), ("muse", "a.norm1")]


def test_psi_and_centroid_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.0, None)], "layer string, psi_0 double, psi_1 double, psi_2 double")
    df.write.parquet(str(tmp_path / "psi"))
    assert tables.read_psi(spark, str(tmp_path / "psi")).first().psi == [1.0, 2.0, None]
    for s in (0, 5):
        raw = np.arange(4, dtype=np.float32).tobytes()
        spark.createDataFrame([("TBUS", float(s), "l", raw, 3)], tables.SCHEMAS["centroids"]).coalesce(1).write.parquet(str(tmp_path / f"centroid_{s}dB_muse_TBUS.parquet"))
    got = tables.read_centroids(spark, str(tmp_path / "centroid_*.parquet"))
    assert got.count() == 2 and got.first().centroid == [0.0, 1.0, 2.0, 3.0]


def test_audio_scans(spark, tmp_path):
    wav(tmp_path / "speech/p226/u1.wav", [0, 16384, -16384], 16000)
    wav(tmp_path / "speech/p999/u2.wav", [1, 2, 3])
    got = tables.clean_speech(spark, str(tmp_path / "speech"), ["p226", "p287"]).collect()
    assert [(r.utt_id, r.speaker, r.n_samples) for r in got] == [("u1", "p226", 3)] and got[0].samples == [0.0, 0.5, -0.5]
    wav(tmp_path / "rirs/Circ/office_1.wav", [100, 0, 0, 9000, 10, -3000, 5, 0], channels=2)
    wav(tmp_path / "rirs/lin/hall_1.wav", [5, 100, 50])
    wav(tmp_path / "rirs/manifests/x.wav", [1])
    rirs = tables.rir_table(spark, str(tmp_path / "rirs"), rooms=["office"]).collect()
    assert [r.rir_name for r in rirs] == ["office_1"] and len(rirs[0].samples) == 4
    (tmp_path / "speech/p999/broken.wav").write_bytes(b"no wave")  # never opened, nor is another room's or noise's
    (tmp_path / "rirs/lin/hall_2.wav").write_bytes(b"no wave")
    wav(tmp_path / "noise/TBUS/ch01.wav", [1, 2])
    wav(tmp_path / "rirs/lin/a{b}_[1].wav", [1, 2])
    (tmp_path / "noise/other/ch01.wav").parent.mkdir()
    (tmp_path / "noise/other/ch01.wav").write_bytes(b"no wave")
    assert tables.clean_speech(spark, str(tmp_path / "speech"), ["p226"]).count() == 1
    assert [r.rir_name for r in tables.rirs_of_test_rooms(spark, str(tmp_path / "rirs")).collect()] == ["office_1"]
    assert [r.rir_name for r in tables.rir_table(spark, str(tmp_path / "rirs"), rooms=["a{b}", "nowhere"]).collect()] == ["a{b}_[1]"]
    assert [r.noise_name for r in tables.noise_table(spark, str(tmp_path / "noise"), names=["TBUS"]).collect()] == ["TBUS"]
    assert tables.clean_speech(spark, str(tmp_path / "speech"), ["p1"]).collect() == []
    for path in ("rirs/lin/hall_2.wav", "rirs/lin/a{b}_[1].wav"):
        (tmp_path / path).unlink()
    files = {r.wav_path: r.family_guess for r in tables.rir_files(spark, str(tmp_path / "rirs")).collect()}
    assert files == {"Circ/office_1.wav": "circular", "lin/hall_1.wav": "linear"}


def test_text_sources(spark, tmp_path):
    (tmp_path / "m1.csv").write_text("wav_path,family\na.wav,old\n ,x\nb.wav, \na.wav,new\n")
    manifest = tables.manifest_families(spark, str(tmp_path / "m1.csv"))
    assert {r.wav_path: r.family for r in manifest.collect()} == {"a.wav": "new", "b.wav": ""}
    files = spark.createDataFrame([("a.wav", "g"), ("b.wav", "g"), ("c.wav", "g")], "wav_path string, family_guess string")
    assert {r.wav_path: r.family for r in tables.with_family(files, manifest).collect()} == {"a.wav": "new", "b.wav": "", "c.wav": "g"}
    (tmp_path / "index.txt").write_text("u1|x/y.wav\n\n u2 |z\nu3\n")
    assert [r.id for r in tables.read_index(spark, str(tmp_path / "index.txt")).collect()] == ["u1", "u2", "u3"]
    split = spark.createDataFrame([("a", "train"), ("b", "test")], "filename string, split string")
    tables.write_split_map(spark, split, str(tmp_path / "split"))
    assert {r.filename: r.split for r in tables.read_split_map(spark, str(tmp_path / "split")).collect()} == {"a": "train", "b": "test"}
    (tmp_path / "split.json").write_text(json.dumps({"q": "train"}))
    assert tables.read_split_map(spark, str(tmp_path / "split.json")).first().filename == "q"
    meta = spark.createDataFrame([("f", "p", "c", 0.123456, 1.0, 2.0, 3.0)], tables.SCHEMAS["rir_metadata"])
    tables.write_metadata(meta, str(tmp_path / "meta"), {"rt60": 4})
    assert tables.read_metadata(spark, str(tmp_path / "meta"), tables.SCHEMAS["rir_metadata"]).first().rt60 == 0.1235


def test_statistics_survive_constant_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", 1.0, 5.0), ("b", 2.0, 3.0), ("b", 3.0, 3.0), ("b", None, 9.0)], "k string, x double, y double")
    got = {r.k: r.r for r in df.groupBy("k").agg(stats.pearson("y", "x").alias("r")).collect()}
    assert got["a"] is None and abs(got["b"] + np.sqrt(3) / 2) < 1e-9
    assert {r.k for r in stats.fit_line(df, ["k"], "y", "x").collect()} == {"b"}
    rho = {r.k: r.rho for r in stats.spearman(df, ["k"], "y", "x").collect()}
    assert rho["a"] is None and abs(rho["b"] + np.sqrt(3) / 2) < 1e-9
    flat = stats.min_max(df, ["k"], "x", "s").where("k = 'a'").first()
    assert flat.s == 0.0


def test_split_invariants(spark):
    rows = [(f"r{i}", -1.0 if i % 10 == 0 else (i % 100) / 90) for i in range(400)]
    df = spark.createDataFrame(rows, "filename string, rt60 double")
    split = sampling.stratified_split(df, "filename", "rt60", 0.8, sampling.hash_order(42, "filename")).join(df, "filename")
    assert split.where("rt60 < 0 AND split = 'test'").count() == 0 and split.count() == 400
    share = split.where("rt60 >= 0").groupBy(F.col("split")).count().collect()
    assert abs({r.split: r["count"] for r in share}["train"] / 360 - 0.8) < 0.03
    assert sampling.assign_k(df, "filename", df.limit(9).select(F.col("filename").alias("m")), "m", 5, sampling.hash_order(1, "filename"), sampling.hash_order(1, "m")).distinct().count() == 2000


def test_evaluation_tables(spark):
    scores = spark.createDataFrame(
        [("reverb", "u", 0.1, 2.0, -1.0, 5.0, 1.0), ("reverb", "v", 1.7, -1.0, 3.0, 7.0, None), ("noise", "w", None, 4.0, 2.0, 1.0, 1.0)],
        "domain string, utterance_id string, rt60 double, pesq double, pesq_input double, si_sdr double, si_sdr_input double",
    )
    whole, bins = jobs.evaluation_report(scores)
    got = {r.domain: r for r in whole.collect()}
    assert got["reverb"].pesq == 2.0 and got["reverb"].pesq_delta == -1.0 and got["reverb"].n == 2
    assert [(r.bin, r.n) for r in bins.collect()] == [("0.0-0.3", 1)]
    assert evaluation.result_table(scores).columns == list(evaluation.FIELDS)


def test_training_pairs(spark):
    waves = spark.createDataFrame([("u", [float(i + 1) for i in range(50)])], "utt_id string, samples array<double>")
    rirs = spark.createDataFrame([(1, [1.0, 0.5, 0.1]), (2, [1.0])], "rir_id int, samples array<double>")
    got = jobs.training_pairs(waves, rirs, 20, 7).collect()
    assert sorted(r.chunk_start for r in got) == [0, 20, 30]
    assert all(abs(np.mean(np.square(r.degraded)) - 1) < 1e-9 for r in got)
    noisy = waves.withColumn("samples", F.transform("samples", lambda x: x * 2))
    row = jobs.noise_training_pairs(waves, noisy, 10, 3).first()
    assert len(row.clean) == len(row.noisy) == 10 and np.allclose(np.array(row.noisy), 2 * np.array(row.clean))


def test_cka_over_the_grid(spark):
    waves = spark.createDataFrame([(f"u{i}", np.random.default_rng(i).normal(size=64).tolist()) for i in range(2)], "utt_id string, samples array<double>")
    noises = spark.createDataFrame([("n", np.random.default_rng(9).normal(size=30).tolist())], "noise_name string, samples array<double>")
    schema = "utt_id string, noise_name string, level double, model string, layer string, call_idx int, time_idx int, token_idx int, vec array<double>"

    def extract(frames):
        import pandas as pd

        for f in frames:
            rows = [(r.utt_id, r.noise_name, r.level, "m", "l", 0, 0, t, list(np.array(r.samples).reshape(16, 4)[t])) for r in f.itertuples() for t in range(16)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    got = jobs.cka_table(waves, noises, [-10.0, 40.0], extract, schema).collect()
    assert len(got) == 4
    by = {(r.utt_id, r.level): r.CKA for r in got}
    assert all(by[u, 40.0] > 0.99 > by[u, -10.0] for u in ("u0", "u1"))


def test_paths_come_from_session_then_environment(spark, monkeypatch):
    monkeypatch.setenv("PROBE_NOISE_PATH", "/env/noise")
    monkeypatch.setenv("PROBE_RIR_PATH", "/env/rir")
    spark.conf.set("probe.path.rir", "/conf/rir")
    got = tables.ProbeConf(speech="/given").filled(spark)
    spark.conf.unset("probe.path.rir")
    assert got == tables.ProbeConf("/given", "/env/noise", "/conf/rir")


def test_activations_of_other_shapes_are_an_error(spark):
    from pyspark.errors import PySparkException

    a = spark.createDataFrame([("m", 0, [1.0, 2.0]), ("m", 1, [2.0, 1.0])], "layer string, token_idx int, vec array<double>")
    b = spark.createDataFrame([("m", 0, [1.0, 2.0])], "layer string, token_idx int, vec array<double>")
    assert represent.paired(a, b, ["layer"], strict=False).count() == 1 and represent.paired(a, a, ["layer"]).count() == 2
    with pytest.raises(PySparkException):
        represent.paired(a, b, ["layer"]).collect()


def test_training_spectra_have_both_sides(spark):
    pairs = spark.createDataFrame([("u", 0, [float(i % 7) for i in range(40)], [float(i % 5) for i in range(40)])], "utt_id string, chunk_start int, clean array<double>, degraded array<double>")
    got = jobs.training_spectra(pairs, ["utt_id", "chunk_start"], n_fft=16, hop=4, win=16).groupBy("side").count().collect()
    assert {r.side: r["count"] for r in got} == {"clean": 11, "degraded": 11}


def test_ranks_of_ranges_equal_the_window(spark):
    """Ties over many rows, null keys and values, one group in several ranges."""
    rng = np.random.default_rng(4)
    rows = [(None if i % 17 == 0 else int(g), float(np.round(x, 1)) if i % 13 else None, i) for i, (g, x) in enumerate(zip(rng.integers(0, 3, 900), rng.normal(size=900), strict=True))]
    df = spark.createDataFrame(rows, "g int, v double, i int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        a, b = ({r.i: r.k for r in f(df, ["g"], "v", "k").collect()} for f in (stats.average_rank, stats.average_rank_ranged))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert a == b and len(a) == 900


def test_profile_is_all_hash_aggregates(spark):
    rows = [(u, f"layer{k}", float(s), u + k + s / 10) for u in range(3) for k in (1, 2, 10) for s in (-5, 0, 10)] + [(0, "layer1", -5.0, 0.5), (0, "layer2", 10.0, 99.0)]
    df = jobs.utterance_profile(spark.createDataFrame(rows, "clean_idx int, layer string, snr double, CKA double"))
    got = {r.clean_idx: (r.first_cka, r.last_cka, r.least_cka, r.n_layers) for r in df.collect()}
    assert got == {0: (0.5, 99.0, 0.5, 3), 1: (1.5, 4.0, 1.5, 3), 2: (2.5, 5.0, 2.5, 3)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
