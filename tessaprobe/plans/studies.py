"""Further registered queries: layer dimensions, readers and writers, data preparation, test sets, evaluation and signals as sums."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessaprobe.functions import exprs, stats
from tessaprobe.functions.constants import representative_layers
from tessaprobe.operators import evaluation, represent, sampling, signal
from tessaprobe.plans import jobs, views
from tessaprobe.plans.registry import DIST, FIT, KEY, RATE, SEED, corr, query, r, ratio_db, rounded
from tessaprobe.plans.views import EVALS, PROBE, PSI, REVERB, RIR_SAMPLES, RIRS, SAMPLES
from tessaprobe.sources import tables
from tessaprobe.sources.shared import shared_folder


def fresh(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- layers -------------------------------------------------------------------------------------------------------

BLOCKS_SQL = """blocks(layer, label, block_order) AS (VALUES ('TCFTransformer.encoder_level1.mhca_blks.0.transformer_layers.0.norm1', 'Enc-L1', 0),
 ('TCFTransformer.encoder_level2.mhca_blks.0.transformer_layers.0.norm1', 'Enc-L2', 1), ('TCFTransformer.latent.mhca_blks.0.transformer_layers.0.norm1', 'Latent', 2),
 ('TCFTransformer.decoder_level2.mhca_blks.0.transformer_layers.0.norm1', 'Dec-L2', 3), ('TCFTransformer.decoder_level1.mhca_blks.0.transformer_layers.0.norm1', 'Dec-L1', 4),
 ('TCFTransformer.mag_refinement.mhca_blks.0.transformer_layers.0.norm1', 'Refinement', 5))"""


@query(f"WITH {PROBE}, {BLOCKS_SQL} SELECT label, CAST(block_order AS INT) AS block_order, {r('avg(CKA)')} AS mean_cka, count(*) AS n FROM probe_facts JOIN blocks USING (layer) GROUP BY 1, 2")
def representative_blocks(spark, d):
    rows = jobs.block_rows(views.probe_facts(spark, d))
    return rounded(rows.groupBy("label", "block_order").agg(F.avg("CKA").alias("mean_cka"), F.count("*").alias("n")), "mean_cka")


@query(f"""WITH {PSI}, {BLOCKS_SQL}, named AS (SELECT b.label, CAST(b.block_order AS INT) AS block_order, snr, i, x FROM psi JOIN blocks b ON psi.layer % 6 = b.block_order WHERE psi.layer < 6),
ref AS (SELECT label, i, x AS y FROM named WHERE snr = (SELECT max(snr) FROM named)), dist AS (SELECT label, block_order, snr AS x, sqrt(sum((x - y) ** 2)) AS y FROM named JOIN ref USING (label, i) GROUP BY 1, 2, 3),
k AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY y) + (count(*) OVER (PARTITION BY label, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY label ORDER BY x) AS rx FROM dist)
SELECT label, block_order, {FIT}, {r(corr('ry', 'rx'))} AS rho FROM k GROUP BY 1, 2""")
def block_monotonicity(spark, d):
    names = representative_layers(spark).select(F.col("layer").alias("name"), "block_order")
    psi = views.psi_table(spark, d).join(names, F.col("layer") == F.col("block_order")).drop("layer", "block_order").withColumnRenamed("name", "layer")
    return rounded(jobs.block_monotonicity(psi), "slope", "intercept", "r2", "rho")


@query(f"""WITH {PROBE}, n AS (SELECT DISTINCT model_name, layer FROM probe_facts)
SELECT model_name, layer, model_name = 'R' OR layer LIKE '%.norm1' AS probed, CASE WHEN lower(layer) LIKE '%encoder%' THEN 'encoder' WHEN lower(layer) LIKE '%decoder_level2%' THEN 'decoder_level2'
 WHEN lower(layer) LIKE '%decoder_level1%' THEN 'decoder_level1' END AS side, layer LIKE '%latent%' OR layer LIKE '%refinement%' AS middle,
 CASE WHEN layer LIKE '%encoder_level1%' THEN 0 WHEN layer LIKE '%encoder_level2%' THEN 1 WHEN layer LIKE '%decoder_level2%' THEN 2 WHEN layer LIKE '%decoder_level1%' THEN 3 ELSE 4 END AS sort_key FROM n""")
def layer_selection(spark, d):
    rows = views.probe_facts(spark, d).select("model_name", "layer").distinct()
    model = F.when(F.col("model_name") == "R", "demucs").otherwise("muse")
    return rows.select(
        "model_name", "layer", exprs.probe_layer(model, "layer").alias("probed"), exprs.side_of("layer").alias("side"), exprs.contains_any("layer", ["latent", "refinement"]).alias("middle"),
        exprs.layer_rank("layer", ("encoder_level1", "encoder_level2", "decoder_level2", "decoder_level1")).alias("sort_key"),
    )


@query(f"""WITH {PROBE} SELECT layer, snr, {r('avg(CKA)')} AS mean_cka, count(*) AS n FROM probe_facts WHERE snr IN (2, 4, 6) AND layer IN (SELECT layer FROM probe_facts WHERE clean_idx = (SELECT min(clean_idx) FROM probe_facts))
GROUP BY 1, 2""")
def known_layer_means(spark, d):
    facts = views.probe_facts(spark, d)
    first = facts.join(facts.agg(F.min("clean_idx").alias("clean_idx")), "clean_idx", "left_semi")
    kept = represent.known_layers(facts.where(F.col("snr").isin(2.0, 4.0, 6.0)), first)
    return rounded(kept.groupBy("layer", "snr").agg(F.avg("CKA").alias("mean_cka"), F.count("*").alias("n")), "mean_cka")


# --- readers and writers --------------------------------------------------------------------------------------------


@query(f"""WITH {PROBE} SELECT model_name, layer, {r('avg(CKA)')} AS mean_cka, count(*) AS n FROM probe_facts GROUP BY 1, 2""")
def union_of_models(spark, d):
    """One table per model, written without the model's name and read as one."""
    facts, paths = views.probe_facts(spark, d), {}
    for model in ("A", "N", "R"):
        paths[model] = fresh(spark, "model")
        tables.write_table(facts.where(F.col("model_name") == model).drop("model_name"), paths[model])
    out = tables.union_models(spark, paths, ["layer", "CKA"])
    return rounded(out.groupBy("model_name", "layer").agg(F.avg("CKA").alias("mean_cka"), F.count("*").alias("n")), "mean_cka")


@query(f"WITH {PSI} SELECT layer, snr, i, {r('x')} AS value FROM psi")
def psi_columns(spark, d):
    """Psi tables come with a column for each coordinate; they are folded into one vector."""
    psi = views.psi_table(spark, d)
    width = psi.select(F.max(F.size("psi"))).first()[0] or 0
    path = fresh(spark, "psi")
    tables.write_table(psi.select("layer", "snr", *[F.col("psi")[k].alias(f"psi_{k}") for k in range(width)]), path)
    rows = tables.read_psi(spark, path).select("layer", "snr", F.posexplode("psi").alias("p", "value"))
    return rounded(rows.select("layer", "snr", (F.col("p") + 1).cast("bigint").alias("i"), "value"), "value")


@query(f"WITH {RIRS} SELECT filename, family, round(rt60, 4) + 0.0 AS rt60, round(c50, 4) + 0.0 AS c50 FROM rir_metadata")
def metadata_round_trip(spark, d):
    """Numbers are formatted as they are written to CSV, and read back as such."""
    path = fresh(spark, "metadata")
    tables.write_metadata(views.rir_metadata(spark, d).select("filename", "family", "rt60", "c50"), path, {"rt60": 4, "c50": 4})
    return rounded(tables.read_metadata(spark, path, "filename string, family string, rt60 double, c50 double"), "rt60", "c50")


@query("SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM labels")
def index_ids(spark, d):
    path = fresh(spark, "index")
    ids = views.table(spark, d, "labels").select("doc_id").distinct()
    ids.select(F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit(" | waves/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("value")).write.text(path)
    return tables.read_index(spark, path)


@query(f"WITH {SAMPLES} SELECT CAST(utt_id AS VARCHAR) AS id, {r('sum(x)')} AS clean, {r('sum(2 * x)')} AS noisy, CAST(16000 AS INT) AS sr FROM samples GROUP BY utt_id")
def staged_import(spark, d):
    path = fresh(spark, "staged")

    def staged(samples):
        return F.struct(samples.alias("array"), F.lit(16000).alias("sampling_rate"))

    rows = views.signals(spark, d).select(F.col("utt_id").cast("string").alias("id"), staged(F.col("samples")).alias("clean"), staged(F.transform("samples", lambda x: 2 * x)).alias("noisy"))
    tables.write_table(rows, path)
    return rounded(tables.import_utterances(spark, path).select("id", exprs.total("clean").alias("clean"), exprs.total("noisy").alias("noisy"), "sr"), "clean", "noisy")


@query(f"""WITH {SAMPLES} SELECT kind, count(DISTINCT utt_id) AS n, {r('sum(x)')} AS total FROM samples, (VALUES ('noise'), ('reverb')) k(kind) GROUP BY 1""")
def degraded_sink(spark, d):
    path = fresh(spark, "pairs")
    pairs = views.signals(spark, d).select("utt_id", "samples", F.explode(F.array(F.lit("noise"), F.lit("reverb"))).alias("kind"))
    tables.write_pairs(pairs, path)
    out = spark.read.parquet(path).groupBy(F.col("kind").cast("string").alias("kind"))
    return rounded(out.agg(F.count_distinct("utt_id").alias("n"), F.sum(exprs.total("samples")).alias("total")), "total")


@query(f"""WITH {EVALS}, e AS (SELECT * FROM eval_scores UNION ALL BY NAME SELECT domain || '_again' AS domain, utterance_id, rt60, si_sdr FROM eval_scores)
SELECT domain, count(*) AS n, count(pesq) AS n_pesq, count(si_sdr) AS n_si_sdr, 0 AS n_stoi, {r('avg(pesq)')} AS pesq FROM e GROUP BY 1""")
def appended_domains(spark, d):
    scores = views.eval_scores(spark, d).withColumn("extra", F.lit(1))
    again = scores.select(F.concat("domain", F.lit("_again")).alias("domain"), "utterance_id", "rt60", "si_sdr")
    out = evaluation.result_table(scores, again)
    assert out.columns == list(evaluation.FIELDS)
    rows = out.groupBy("domain").agg(
        F.count("*").alias("n"), F.count("pesq").alias("n_pesq"), F.count("si_sdr").alias("n_si_sdr"), F.count("stoi").cast("int").alias("n_stoi"), F.avg("pesq").alias("pesq")
    )
    return rounded(rows, "pesq")


# --- responses, splits and test sets --------------------------------------------------------------------------------

ACOUSTICS = f"""{RIR_SAMPLES}, back AS (SELECT rir_id, i, sum(x * x) OVER (PARTITION BY rir_id ORDER BY i DESC) AS e, sum(x * x) OVER (PARTITION BY rir_id) AS total FROM aligned),
db AS (SELECT rir_id, i, 10 * log10(e / (total + 1e-12) + 1e-12) AS l FROM back),
hits AS (SELECT rir_id, coalesce(min(i) FILTER (WHERE l <= -5), 0) AS a, coalesce(min(i) FILTER (WHERE l <= -25), 0) AS b, coalesce(min(i) FILTER (WHERE l <= -15), 0) AS c FROM db GROUP BY 1),
picked AS (SELECT rir_id, a, CASE WHEN a > 0 AND b > a THEN b WHEN c > a AND a > 0 THEN c END AS z, a > 0 AND b > a AS strict FROM hits),
slopes AS (SELECT p.rir_id, strict, (y.l - x.l) / ((z - a) / 1000.0) AS s FROM picked p LEFT JOIN db x ON p.rir_id = x.rir_id AND x.i = a LEFT JOIN db y ON p.rir_id = y.rir_id AND y.i = z),
times AS (SELECT rir_id, round(CASE WHEN s IS NULL OR abs(s) < 1e-6 OR (strict AND -60 / s <= 0) THEN -1 ELSE -60 / s END, 4) + 0.0 AS rt60 FROM slopes),
ratios AS (SELECT rir_id, round({ratio_db(2)}, 2) + 0.0 AS drr, round({ratio_db(50)}, 2) + 0.0 AS c50, round({ratio_db(80)}, 2) + 0.0 AS c80 FROM aligned GROUP BY 1)"""


@query(f"""WITH {ACOUSTICS} SELECT CASE WHEN rir_id % 2 = 0 THEN 'circ_' ELSE 'lin_' END || 'r' || rir_id AS filename, rt60, drr, c50, c80 FROM times JOIN ratios USING (rir_id)""")
def rir_metadata_job(spark, d):
    rows = views.rirs(spark, d).select(
        F.concat(F.lit("rooms/r"), F.col("rir_id").cast("string"), F.lit(".wav")).alias("wav_path"), F.when(F.col("rir_id") % 2 == 0, "circular").otherwise("linear").alias("family"), "samples"
    )
    return jobs.rir_metadata(rows, RATE).select("filename", *[(F.col(c) + 0.0).alias(c) for c in ("rt60", "drr", "c50", "c80")])


@query(f"WITH {RIRS} SELECT filename, CASE WHEN lower(trim(split)) LIKE 'economy%' THEN 'test' ELSE 'train' END AS split FROM rir_metadata")
def rir_split_official(spark, d):
    given = F.when(F.lower(F.trim("split")).startswith("economy"), " Test").otherwise("validation")
    return jobs.rir_split(views.rir_metadata(spark, d).withColumn("split", given), 0.8, exprs.portable_key("rir_idx", SEED))


TESTED = f"""{RIRS}, wanted AS (SELECT filename FROM rir_metadata WHERE split LIKE 'ECONOMY%'), lacking AS (SELECT DISTINCT 'rir_x' || s_suppkey AS filename FROM supplier WHERE s_suppkey % 10 = 0)"""


def _tested(spark, d):
    meta = views.rir_metadata(spark, d).select("rir_idx", "filename", F.concat(F.lit("waves/"), "filename").alias("wav_path"), "rt60", (F.col("rt60") * 2).alias("drr"), "c50", "split")
    lacking = views.table(spark, d, "supplier").where("s_suppkey % 10 = 0").select(F.concat(F.lit("rir_x"), F.col("s_suppkey").cast("string")).alias("filename"), F.lit("test").alias("split"))
    split = meta.select("filename", F.when(F.col("split").startswith("ECONOMY"), "test").otherwise("train").alias("split")).unionByName(lacking)
    return jobs.test_responses(split, meta)


@query(f"WITH {TESTED} SELECT filename, false AS missing FROM wanted UNION ALL SELECT filename, true FROM lacking")
def test_set_responses(spark, d):
    found, missing = _tested(spark, d)
    return found.select("filename", F.lit(False).alias("missing")).unionByName(missing.select("filename", F.lit(True).alias("missing")))


@query(f"""WITH {TESTED}, meta AS (SELECT m.*, row_number() OVER (ORDER BY {KEY.format('rir_idx')}, filename) - 1 AS k, count(*) OVER () AS n FROM rir_metadata m SEMI JOIN wanted USING (filename))
SELECT c_custkey AS utterance_id, filename AS rir_id, 'waves/' || filename AS rir_filename, {r('rt60')} AS rt60, {r('rt60 * 2')} AS drr, {r('c50')} AS c50, c_custkey || '_' || filename || '.wav' AS filepath
FROM customer, range(0, 5) s(s) JOIN meta ON ({KEY.format('c_custkey')} + s.s) % n = k""")
def reverb_manifest(spark, d):
    found, _ = _tested(spark, d)
    utterances = views.table(spark, d, "customer").select(F.col("c_custkey").alias("utterance_id"))
    ordered = found.withColumn("_key", exprs.portable_key("rir_idx", SEED))
    named = ordered.select(F.col("filename"), "wav_path", "rt60", "drr", "c50", "_key")
    order = exprs.portable_key(F.regexp_extract("rir_id", "[0-9]+$", 0), SEED)
    return rounded(jobs.reverb_manifest(utterances, named, 5, exprs.portable_key("utterance_id", SEED), order), "rt60", "drr", "c50")


@query("SELECT c_custkey AS utterance_id, c_custkey || '.wav' AS filepath FROM customer")
def noise_manifest(spark, d):
    return jobs.noise_manifest(views.table(spark, d, "customer").select(F.col("c_custkey").alias("utterance_id")))


@query(f"SELECT p_partkey, row_number() OVER (ORDER BY {KEY.format('p_partkey')}, p_partkey) - 1 AS place FROM part")
def seeded_shuffle(spark, d):
    rows = views.table(spark, d, "part").select("p_partkey")
    return sampling.numbered(rows, [exprs.portable_key("p_partkey", SEED), "p_partkey"], "place").select("p_partkey", F.col("place").cast("bigint").alias("place"))


# --- evaluation -----------------------------------------------------------------------------------------------------


@query(f"""WITH {EVALS} SELECT {r('avg(CASE WHEN utterance_id % 13 <> 0 THEN pesq END)')} AS pesq, {r('avg(si_sdr)')} AS si_sdr FROM eval_scores""")
def validation_means(spark, d):
    scores = views.eval_scores(spark, d).withColumn("pesq", F.when(F.col("utterance_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("pesq").cast("double")))
    return rounded(evaluation.validation_means(scores.withColumn("si_sdr", F.col("si_sdr").cast("double")), "pesq", "si_sdr"), "pesq", "si_sdr")


def _db(e: str) -> str:
    return f"10 * log10(((re{e} / (rr + 1e-10)) ** 2 * rr + 1e-10) / (ee{e} - 2 * (re{e} / (rr + 1e-10)) * re{e} + (re{e} / (rr + 1e-10)) ** 2 * rr + 1e-10))"


@query(f"""WITH {SAMPLES}, three AS (SELECT a.utt_id, a.x AS r, b.x AS s, c.x AS t FROM samples a JOIN samples b ON b.utt_id = a.utt_id + 1 AND a.i = b.i JOIN samples c ON c.utt_id = a.utt_id + 2 AND a.i = c.i),
sums AS (SELECT utt_id, sum(r * r) AS rr, sum(r * s) AS re1, sum(s * s) AS ee1, sum(r * t) AS re2, sum(t * t) AS ee2 FROM three GROUP BY 1)
SELECT 'reverb' AS domain, CAST(utt_id AS VARCHAR) AS utterance_id, 'rir_' || utt_id % 7 AS rir_id, {r('utt_id % 9 / 10.0')} AS rt60, {r('utt_id % 11 - 2.5')} AS c50, {r(_db('2'))} AS si_sdr, {r(_db('1'))} AS si_sdr_input FROM sums""")
def evaluation_job(spark, d):
    """The manifest's files, degraded (the next signal) and enhanced (the one after it), against the clean signal."""
    waves = views.signals(spark, d)

    def file(k: int):
        return waves.select(F.concat((F.col("utt_id") - k).cast("string"), F.lit(".wav")).alias("filepath"), "samples")

    manifest = waves.select(
        F.col("utt_id").cast("string").alias("utterance_id"), F.concat(F.lit("rir_"), (F.col("utt_id") % 7).cast("string")).alias("rir_id"), (F.col("utt_id") % 9 / 10).alias("rt60"),
        (F.col("utt_id") % 11 - 2.5).alias("c50"), F.concat(F.col("utt_id").cast("string"), F.lit(".wav")).alias("filepath"),
    )
    out = jobs.evaluated(manifest, file(1), file(2), waves.select(F.col("utt_id").cast("string").alias("utterance_id"), "samples"), "reverb")
    return rounded(out.select("domain", "utterance_id", "rir_id", "rt60", "c50", "si_sdr", "si_sdr_input"), "rt60", "c50", "si_sdr", "si_sdr_input")


@query("""WITH e AS (SELECT label AS layer, CAST(vec_id % 5 AS DOUBLE) AS snr, vec_id % 3 AS noise, unnest(range(1, 6)) AS i, unnest(embedding[1:5])::DOUBLE AS v FROM embeddings),
p AS (SELECT layer, snr, noise, i, avg(v) AS x FROM e GROUP BY ALL), l AS (SELECT *, x - lag(x) OVER (PARTITION BY layer, snr, noise ORDER BY i) AS step FROM p),
b AS (SELECT layer, bool_and(layer % 2 = 0 OR step IS NULL OR step <= 1e-5) AS eigenvalues_descend, min(c) AS least_components, max(c) AS most_components
 FROM (SELECT *, CAST(2 + noise AS INT) AS c FROM l) GROUP BY 1), f AS (SELECT layer, snr, noise, x FROM p WHERE i = 1),
k AS (SELECT layer, rank() OVER (PARTITION BY layer ORDER BY x) + (count(*) OVER (PARTITION BY layer, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY layer ORDER BY snr) + (count(*) OVER (PARTITION BY layer, snr) - 1) / 2.0 AS rs FROM f),
""" + f"""rho AS (SELECT layer, {r(corr('rx', 'rs'))} AS rho FROM k GROUP BY 1), m AS (SELECT layer, noise, avg(x) AS m FROM f GROUP BY 1, 2),
s AS (SELECT layer, {r('stddev_samp(m)')} AS spread, count(*) AS n_noises FROM m GROUP BY 1)
SELECT layer, least_components, most_components, eigenvalues_descend, rho, spread, n_noises FROM b JOIN rho USING (layer) JOIN s USING (layer)""")
def quality_report(spark, d):
    rows = views.all_vectors(spark, d).withColumns({"snr": (F.col("vec_id") % 5).cast("double"), "noise_name": (F.col("vec_id") % 3).cast("string"), "vec": F.slice("vec", 1, 5)})
    psi = represent.centroids(rows, ["layer", "snr", "noise_name"]).withColumnRenamed("vec", "psi")
    ordered = F.when(F.col("layer") % 2 == 0, F.sort_array("psi", asc=False)).otherwise(F.col("psi"))
    psi = psi.withColumns({"eigenvalues": ordered, "n_components": (2 + F.col("noise_name").cast("int")).cast("int")})
    return rounded(jobs.quality_report(psi), "rho", "spread")


# --- signals as sums ------------------------------------------------------------------------------------------------

CONVOLVED = f"""{RIR_SAMPLES}, utts AS (SELECT utt_id, row_number() OVER (ORDER BY utt_id) - 1 AS k, count(*) OVER () AS c FROM (SELECT DISTINCT utt_id FROM samples)),
dealt AS (SELECT a.utt_id, b.utt_id AS rir_id FROM utts a JOIN utts b ON (a.k + SHIFT) % a.c = b.k),
parts AS (SELECT rir_id, sum(x * x) FILTER (WHERE i < 20) AS e, coalesce(sum(x * x) FILTER (WHERE i >= 20), 0) AS late FROM aligned GROUP BY 1),
factors AS (SELECT rir_id, CASE WHEN late < 1e-10 THEN 1e-10 WHEN e < 1e-10 THEN 1e6 ELSE greatest(1e-10, least(1e6, sqrt(e / (10 * late + 1e-10)))) END AS f FROM parts),
wet AS (SELECT s.utt_id, d.rir_id, s.i + h.i AS t, any_value(s.n) AS n, sum(s.x * h.x * CASE WHEN h.i >= 20 AND CONTROLLED THEN f ELSE 1 END) AS y
 FROM samples s JOIN dealt d USING (utt_id) JOIN aligned h ON h.rir_id = d.rir_id JOIN factors q ON q.rir_id = d.rir_id WHERE s.i + h.i < s.n GROUP BY ALL)
SELECT utt_id, rir_id, {r('log10(sum(y * y))')} AS energy, CAST(any_value(n) AS INT) AS n FROM wet GROUP BY 1, 2"""


def _wet(spark, d, target, shift):
    speech = views.signals(spark, d)
    rir = views.rirs(spark, d)
    dealt = sampling.assign_mod(speech, "utt_id", rir, "rir_id", shift)
    waves = speech.join(dealt, "utt_id").withColumn("target_c50", F.lit(10.0))
    out = signal.reverberate(waves, rir, "rir_id", target=target, early=20)
    return rounded(out.select("utt_id", "rir_id", F.log10(exprs.energy("reverberant")).alias("energy"), F.size("reverberant").alias("n")), "energy")


@query("WITH " + CONVOLVED.replace("SHIFT", "0").replace("CONTROLLED", "true"))
def reverberated(spark, d):
    return _wet(spark, d, "target_c50", 0)


@query("WITH " + CONVOLVED.replace("SHIFT", "3").replace("CONTROLLED", "false"))
def plain_reverberated(spark, d):
    return _wet(spark, d, None, 3)


SPECTRA = f"""{SAMPLES}, sizes AS (SELECT DISTINCT utt_id, n FROM samples), frames AS (SELECT utt_id, n, unnest(range(0, n // 4 + 1)) AS f FROM sizes),
taps AS (SELECT utt_id, n, f, unnest(range(0, 16)) AS t FROM frames),
spots AS (SELECT utt_id, f, t, CASE WHEN n > 8 THEN CASE WHEN f * 4 + t - 8 < 0 THEN 8 - f * 4 - t WHEN f * 4 + t - 8 >= n THEN 2 * (n - 1) - (f * 4 + t - 8) ELSE f * 4 + t - 8 END
 ELSE greatest(0, least(n - 1, f * 4 + t - 8)) END AS i FROM taps),
w AS (SELECT utt_id, f, t, x * (0.5 - 0.5 * cos(2 * pi() * t / 16)) AS v FROM spots JOIN samples USING (utt_id, i)),
bins AS (SELECT utt_id, f, k, sum(v * cos(2 * pi() * k * t / 16)) AS re, -sum(v * sin(2 * pi() * k * t / 16)) AS im FROM w, range(0, 9) b(k) GROUP BY 1, 2, 3),
spectra AS (SELECT utt_id, f, k, sqrt(re * re + im * im) AS mag, atan2(im, re) AS pha FROM bins)"""


@query(f"WITH {SAMPLES} SELECT utt_id, i, {r('x')} AS x FROM samples WHERE i < n // 4 * 4")
def stft_round_trip(spark, d):
    """The inverse of the transform gives the signal again."""
    waves = views.signals(spark, d)
    back = signal.istft(signal.stft(waves, ["utt_id"], n_fft=16, hop=4, win=16, power=0.3), ["utt_id"], 16, 4, 16, 0.3).withColumnRenamed("samples", "again")
    return rounded(back.select("utt_id", F.posexplode("again").alias("i", "x")).withColumn("i", F.col("i").cast("bigint")), "x")


@query(f"WITH {SPECTRA} SELECT utt_id, f AS frame_idx, {r('sum(mag)')} AS mag, {r('sum(mag * mag)')} AS energy FROM spectra GROUP BY 1, 2")
def stft_frames(spark, d):
    out = signal.stft(views.signals(spark, d), ["utt_id"], n_fft=16, hop=4, win=16)
    return rounded(out.select("utt_id", F.col("frame_idx").cast("bigint").alias("frame_idx"), exprs.total("mag").alias("mag"), exprs.energy("mag").alias("energy")), "mag", "energy")


@query(f"WITH {SPECTRA} SELECT utt_id, f AS frame_idx, {r('sum(20 * log10(mag + 1e-8))')} AS db FROM spectra GROUP BY 1, 2")
def log_spectrogram(spark, d):
    out = signal.log_spectrogram(views.signals(spark, d), ["utt_id"], n_fft=16, hop=4)
    return rounded(out.select("utt_id", F.col("frame_idx").cast("bigint").alias("frame_idx"), exprs.total("db").alias("db")), "db")


def _wrapped(x: str) -> str:
    return f"abs({x} - round(({x}) / (2 * pi())) * 2 * pi())"


@query(f"""WITH {SPECTRA}, met AS (SELECT a.utt_id, a.f, a.k, a.mag AS mr, a.pha AS pr, b.mag AS mg, b.pha AS pg FROM spectra a JOIN spectra b ON b.utt_id = a.utt_id + 1 AND a.f = b.f AND a.k = b.k),
steps AS (SELECT *, coalesce(lag(pr) OVER g, 0) - pr AS gr, coalesce(lag(pg) OVER g, 0) - pg AS gg, coalesce(lag(pr) OVER t, 0) - pr AS tr, coalesce(lag(pg) OVER t, 0) - pg AS tg FROM met
 WINDOW g AS (PARTITION BY utt_id, f ORDER BY k), t AS (PARTITION BY utt_id, k ORDER BY f))
SELECT utt_id, {r('avg((mr - mg) ** 2)')} AS mag_mse, {r('avg((mr * cos(pr) - mg * cos(pg)) ** 2) / 2 + avg((mr * sin(pr) - mg * sin(pg)) ** 2) / 2')} AS complex_mse,
 {r(f"avg({_wrapped('pr - pg')})")} AS phase_ip, {r(f"avg({_wrapped('gr - gg')})")} AS phase_gd, {r(f"avg({_wrapped('tr - tg')})")} AS phase_iaf FROM steps GROUP BY 1""")
def spectral_distance(spark, d):
    frames = signal.stft(views.signals(spark, d), ["utt_id"], n_fft=16, hop=4, win=16, parts=("mag", "pha"))
    left = frames.select("utt_id", "frame_idx", F.col("mag").alias("mag_r"), F.col("pha").alias("pha_r"))
    right = frames.select((F.col("utt_id") - 1).alias("utt_id"), "frame_idx", F.col("mag").alias("mag_g"), F.col("pha").alias("pha_g"))
    out = signal.spectral_distances(left.join(right, ["utt_id", "frame_idx"]), ["utt_id"])
    return rounded(out, "mag_mse", "complex_mse", "phase_ip", "phase_gd", "phase_iaf")


@query(f"""WITH {SAMPLES}, sizes AS (SELECT DISTINCT utt_id, n FROM samples), new AS (SELECT utt_id, unnest(range(0, (n + 2) // 3)) AS k FROM sizes),
taps AS (SELECT utt_id, k, x, (k * 3 - i) / 3.0 AS g FROM new JOIN samples USING (utt_id) WHERE k * 3 - i BETWEEN -96 AND 96)
SELECT utt_id, CAST(count(DISTINCT k) AS INT) AS n, {r('sum(x * CASE WHEN g = 0 THEN 1 ELSE sin(pi() * g) / (pi() * g) END * (0.5 + 0.5 * cos(pi() * greatest(-1, least(1, g / 32)))) / 3)')} AS total FROM taps GROUP BY 1""")
def resampled_signals(spark, d):
    out = views.signals(spark, d).select("utt_id", signal.resample("samples", 48000, 16000).alias("x"))
    return rounded(out.select("utt_id", F.size("x").alias("n"), exprs.total("x").alias("total")), "total")


@query(f"WITH {SAMPLES}, p AS (SELECT utt_id, i, CASE WHEN utt_id % 2 = 0 THEN -x ELSE x END AS x FROM samples) SELECT utt_id, {r('sum(x) / greatest(max(abs(x)), 1e-8)')} AS total FROM p GROUP BY 1")
def channel_and_peak(spark, d):
    """Of one or two channels the second, or the only one; scaled to a peak of 1."""
    negative = F.transform("samples", lambda x: -x)
    channels = F.when(F.col("utt_id") % 2 == 0, F.array("samples", negative)).otherwise(F.array("samples"))
    rows = views.signals(spark, d).select("utt_id", exprs.channel(channels, 1).alias("x"))
    return rounded(rows.select("utt_id", exprs.total(exprs.peak_normalised("x")).alias("total")), "total")


# --- activations ----------------------------------------------------------------------------------------------------

ROWS = """WITH e AS (SELECT label AS layer, (vec_id // 10) % 4 AS call_idx, vec_id % 2 AS batch_idx, vec_id AS token_idx, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"""


def _rows(spark, d):
    return views.all_vectors(spark, d).select("layer", (F.floor(F.col("vec_id") / 10) % 4).alias("call_idx"), (F.col("vec_id") % 2).alias("batch_idx"), F.col("vec_id").alias("token_idx"), "vec")


@query(f"{ROWS} SELECT layer, token_idx, {r('sum(v)')} AS total FROM e WHERE call_idx = 0 AND batch_idx = 0 GROUP BY 1, 2")
def first_segment(spark, d):
    return rounded(represent.first_segment(_rows(spark, d)).select("layer", "token_idx", exprs.total("vec").alias("total")), "total")


@query(f"""{ROWS}, m AS (SELECT *, max(call_idx) OVER (PARTITION BY layer) AS last FROM e), c AS (SELECT layer, call_idx, batch_idx, i, avg(v) AS v FROM m WHERE call_idx < last OR last = 0 GROUP BY ALL),
p AS (SELECT layer, batch_idx AS token_idx, i, avg(v) AS v FROM c GROUP BY ALL) SELECT layer, token_idx, {r('sum(v)')} AS total, {r('sum(v * v)')} AS energy FROM p GROUP BY 1, 2""")
def pool_means_without_last(spark, d):
    calls = _rows(spark, d).withColumn("token_idx", F.col("batch_idx"))
    out = represent.pool_mean_of_means(calls, ["layer"], drop_last=True)
    return rounded(out.select("layer", "token_idx", exprs.total("vec").alias("total"), exprs.energy("vec").alias("energy")), "total", "energy")


@query(f"""WITH {REVERB}, t AS (SELECT model_name, target_c50, avg(CKA) AS m FROM reverb_facts GROUP BY 1, 2),
s AS (SELECT *, min(m) OVER (PARTITION BY model_name) AS low, max(m) OVER (PARTITION BY model_name) AS high FROM t)
SELECT model_name, target_c50, {r('CASE WHEN high > low THEN (m - low) / (high - low) ELSE 0 END')} AS scaled FROM s""")
def scaled_reverb_means(spark, d):
    means = views.reverb_facts(spark, d).groupBy("model_name", "target_c50").agg(F.avg("CKA").cast("double").alias("m"))
    return rounded(stats.min_max(means, ["model_name"], "m", "scaled").select("model_name", "target_c50", "scaled"), "scaled")


@query(f"{DIST} SELECT layer, count(*) AS n, {r('max(dist)')} AS furthest FROM dist WHERE dist IS NOT NULL GROUP BY 1")
def furthest_levels(spark, d):
    from tessaprobe.operators import manifold

    dist = manifold.distance_from_reference(views.psi_table(spark, d)).dropna(subset=["dist"])
    return rounded(dist.groupBy("layer").agg(F.count("*").alias("n"), F.max("dist").alias("furthest")), "furthest")


@query(f"""WITH k AS (SELECT l_returnflag AS model_name, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS ry,
 rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rx FROM lineitem)
SELECT model_name, {r(corr('ry', 'rx'))} AS rho FROM k GROUP BY 1""")
def large_group_spearman(spark, d):
    """Three groups that hold all rows between them: ranks go range by range, no task has a group."""
    rows = views.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model_name"), "l_extendedprice", "l_quantity")
    return rounded(stats.spearman(rows, ["model_name"], "l_extendedprice", "l_quantity", rank=stats.average_rank_ranged), "rho")
