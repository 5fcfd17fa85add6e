"""Registered queries over the driver's tables, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaprobe.functions import exprs, stats
from tessaprobe.operators import evaluation, kernels, manifold, represent, sampling, signal
from tessaprobe.plans import jobs, views
from tessaprobe.plans.views import EVALS, PROBE, PSI, REVERB, RIR_SAMPLES, RIRS, SAMPLES, TOKENS

LEVELS = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0)
RATE = 1000  # the stand-in signals count as sampled at 1 kHz, so that windows of milliseconds fit them
SEED = 12345
KEY = "(CAST({} AS BIGINT) * 1103515245 + 12345) % 2147483647"

_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(fn):
        _found[fn.__name__] = (fn, sql)
        return fn

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns})


def r(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


FIT = f"{r('regr_slope(y, x)')} AS slope, {r('regr_intercept(y, x)')} AS intercept, {r('regr_r2(y, x)')} AS r2, count(DISTINCT x) AS n_levels"


def corr(y: str, x: str) -> str:
    return f"covar_pop({y}, {x}) / nullif(stddev_pop({y}) * stddev_pop({x}), 0)"


# --- probe analytics ------------------------------------------------------------------------------------------------


@query(f"""WITH {PROBE}, m AS (SELECT layer, snr AS x, avg(CKA) AS y FROM probe_facts WHERE layer LIKE '%.norm1' AND snr IS NOT NULL GROUP BY 1, 2)
SELECT layer, {FIT}, CASE WHEN layer LIKE '%encoder_level1%' THEN 0 WHEN layer LIKE '%encoder_level2%' THEN 1 WHEN layer LIKE '%latent%' THEN 2
 WHEN layer LIKE '%decoder_level2%' THEN 3 WHEN layer LIKE '%decoder_level1%' THEN 4 WHEN layer LIKE '%mag_refinement%' THEN 5 ELSE 6 END AS block_rank
FROM m GROUP BY layer HAVING count(DISTINCT x) >= 2""")
def layer_sensitivity(spark, d):
    return rounded(jobs.layer_sensitivity(views.probe_facts(spark, d)), "slope", "intercept", "r2")


@query(f"WITH {PROBE} SELECT layer, " + ", ".join(f"{r(f'avg(CASE WHEN snr = {int(x)} THEN CKA END)')} AS snr_{int(x)}" for x in LEVELS) + " FROM probe_facts GROUP BY layer")
def layer_level_heat(spark, d):
    return rounded(jobs.level_heat(views.probe_facts(spark, d), LEVELS), *[f"snr_{int(x)}" for x in LEVELS])


TREND = f"WITH {PROBE}, m AS (SELECT model_name, layer, snr AS x, avg(CKA) AS y FROM probe_facts GROUP BY 1, 2, 3)"
RAW_FITS = (
    f"{TREND}, fits AS (SELECT model_name, layer, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM m "
    "GROUP BY 1, 2 HAVING count(DISTINCT x) >= 2)"
)


@query(f"{TREND} SELECT model_name, layer, {FIT} FROM m GROUP BY 1, 2 HAVING count(DISTINCT x) >= 2")
def cross_model_trend(spark, d):
    return rounded(jobs.cross_model(views.probe_facts(spark, d)), "slope", "intercept", "r2")


@query(f"""{RAW_FITS}, ranked AS (SELECT *, rank() OVER (PARTITION BY model_name ORDER BY slope) + (count(*) OVER (PARTITION BY model_name, slope) - 1) / 2.0 AS rs,
  rank() OVER (PARTITION BY model_name ORDER BY intercept) + (count(*) OVER (PARTITION BY model_name, intercept) - 1) / 2.0 AS ri FROM fits)
SELECT model_name, count(*) AS n_layers, {r(corr('slope', 'intercept'))} AS r, {r(corr('rs', 'ri'))} AS rho, {r('regr_slope(slope, intercept)')} AS fit_slope,
 {r('regr_intercept(slope, intercept)')} AS fit_intercept, {', '.join(f"{r(f'avg({c})')} AS mean_{c}, {r(f'median({c})')} AS median_{c}" for c in ('slope', 'intercept', 'r2'))}
FROM ranked GROUP BY 1 HAVING count(*) >= 2""")
def model_trend_corr(spark, d):
    out = jobs.trend_statistics(jobs.cross_model(views.probe_facts(spark, d)))
    return rounded(out, *[c for c in out.columns if c not in ("model_name", "n_layers")])


@query(f"""{RAW_FITS}, lines AS (SELECT model_name, regr_slope(slope, intercept) AS s, regr_intercept(slope, intercept) AS c, min(intercept) AS low, max(intercept) AS high
 FROM fits GROUP BY 1), points AS (SELECT *, unnest(range(0, 100)) AS i FROM lines)
SELECT model_name, i, {r('low + (high - low) * i / 99')} AS x, {r('s * (low + (high - low) * i / 99) + c')} AS y FROM points""")
def trend_line_points(spark, d):
    out = jobs.trend_points(jobs.cross_model(views.probe_facts(spark, d)))
    return rounded(out.withColumn("i", F.col("i").cast("bigint")), "x", "y")


@query(f"""WITH {PROBE}, c AS (SELECT layer, CKA - avg(CKA) OVER w AS a, enhanced_pesq - noisy_pesq - avg(enhanced_pesq - noisy_pesq) OVER w AS b
 FROM probe_facts WHERE layer LIKE '%.norm1' WINDOW w AS (PARTITION BY layer, snr))
SELECT layer, {r(corr('a', 'b'))} AS r, count(*) AS n FROM c GROUP BY 1""")
def centered_corr(spark, d):
    return rounded(jobs.gain_correlation(views.probe_facts(spark, d)), "r")


@query(f"""WITH {PROBE}, k AS (SELECT *, concat(layer, '#', CAST(CAST(snr AS INT) AS VARCHAR)) AS key FROM probe_facts)
SELECT clean_idx, {r('first(CKA ORDER BY key, CKA)')} AS first_cka, {r('last(CKA ORDER BY key, CKA)')} AS last_cka, {r('min(CKA)')} AS least_cka, count(DISTINCT layer) AS n_layers FROM k GROUP BY 1""")
def utterance_profile(spark, d):
    return rounded(jobs.utterance_profile(views.probe_facts(spark, d)), "first_cka", "last_cka", "least_cka")


@query(f"""WITH {REVERB}, m AS (SELECT layer, target_c50 AS x, avg(CKA) AS y FROM reverb_facts WHERE layer LIKE '%.norm1' AND target_c50 BETWEEN -5 AND 25 GROUP BY 1, 2)
SELECT layer, {FIT} FROM m GROUP BY layer HAVING count(DISTINCT x) >= 2""")
def c50_sensitivity(spark, d):
    return rounded(jobs.reverb_sensitivity(views.reverb_facts(spark, d)), "slope", "intercept", "r2")


@query(f"""WITH {PROBE} SELECT layer, snr, {r('avg(CKA)')} AS mean_cka, count(*) AS n, count(DISTINCT clean_idx) AS n_utterances FROM probe_facts GROUP BY 1, 2""")
def level_means(spark, d):
    out = views.probe_facts(spark, d).groupBy("layer", "snr").agg(F.avg("CKA").alias("mean_cka"), F.count("*").alias("n"), F.count_distinct("clean_idx").alias("n_utterances"))
    return rounded(out, "mean_cka")


@query(f"""WITH {PROBE} SELECT layer, CASE WHEN layer LIKE '%encoder_level1%' THEN 0 WHEN layer LIKE '%encoder_level2%' THEN 1 WHEN layer LIKE '%latent%' THEN 2
 WHEN layer LIKE '%decoder_level2%' THEN 3 WHEN layer LIKE '%decoder_level1%' THEN 4 ELSE 5 END AS rank, row_number() OVER (ORDER BY rank, layer) AS place FROM (SELECT DISTINCT layer FROM probe_facts)""")
def ranked_layers(spark, d):
    return jobs.ranked_layers(views.probe_facts(spark, d))


# --- samples and splits ---------------------------------------------------------------------------------------------

SAMPLED = """keys AS (SELECT DISTINCT snr, noise_name, clean_idx FROM probe_facts), drawn AS (SELECT * FROM keys
 QUALIFY row_number() OVER (PARTITION BY snr, noise_name ORDER BY """ + KEY.format("clean_idx") + ", clean_idx) <= 20)"


@query(f"""WITH {PROBE}, {SAMPLED} SELECT f.snr, f.noise_name, f.clean_idx, f.layer, {r('f.CKA')} AS CKA FROM probe_facts f SEMI JOIN drawn USING (snr, noise_name, clean_idx)""")
def per_cell_sample(spark, d):
    out = sampling.per_cell_sample(views.probe_facts(spark, d), ["snr", "noise_name"], "clean_idx", 20, exprs.portable_key("clean_idx", SEED))
    return rounded(out.select("snr", "noise_name", "clean_idx", "layer", "CKA"), "CKA")


STRIDED = """levels AS (SELECT target_c50, row_number() OVER (ORDER BY target_c50) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT target_c50 FROM reverb_facts)),
strided AS (SELECT target_c50 FROM levels WHERE k % greatest(1, n // 5) = 0 AND k // greatest(1, n // 5) < 5)"""


@query(f"WITH {REVERB}, {STRIDED} SELECT target_c50 FROM strided")
def strided_levels(spark, d):
    return sampling.strided_levels(views.reverb_facts(spark, d), "target_c50")


@query(f"""WITH {REVERB}, levels AS (SELECT target_c50, row_number() OVER (ORDER BY target_c50) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT target_c50 FROM reverb_facts))
SELECT target_c50 FROM levels WHERE n <= 6 OR k IN (0, n // 4, n // 2, 3 * n // 4, n - 2, n - 1)""")
def slice_levels(spark, d):
    return sampling.slice_levels(views.reverb_facts(spark, d), "target_c50")


@query(f"""WITH {REVERB}, {STRIDED}, pinned AS (SELECT * FROM reverb_facts SEMI JOIN strided USING (target_c50)),
one AS (SELECT * FROM pinned WHERE rir_name = (SELECT min(rir_name) FROM pinned)), keys AS (SELECT DISTINCT target_c50, clean_idx FROM one),
drawn AS (SELECT * FROM keys QUALIFY row_number() OVER (PARTITION BY target_c50 ORDER BY {KEY.format('clean_idx')}, clean_idx) <= 20)
SELECT target_c50, rir_name, clean_idx, layer, {r('CKA')} AS CKA FROM one SEMI JOIN drawn USING (target_c50, clean_idx)""")
def subset_build(spark, d):
    out = jobs.demo_subset_reverb(views.reverb_facts(spark, d), 20, exprs.portable_key("clean_idx", SEED))
    return rounded(out.select("target_c50", "rir_name", "clean_idx", "layer", "CKA"), "CKA")


SPLIT = f"""binned AS (SELECT *, CASE WHEN rt60 < 0 THEN -1 WHEN rt60 < 0.2 THEN 0 WHEN rt60 < 0.4 THEN 1 WHEN rt60 < 0.6 THEN 2 WHEN rt60 < 0.8 THEN 3 ELSE 4 END AS bin FROM rir_metadata),
placed AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {KEY.format('rir_idx')}, filename) AS k, greatest(1, floor(count(*) OVER (PARTITION BY bin) * 0.8)) AS most FROM binned),
divided AS (SELECT filename, family, CASE WHEN bin = -1 OR k <= most THEN 'train' ELSE 'test' END AS split FROM placed)"""


def _split(spark, d):
    return sampling.stratified_split(views.rir_metadata(spark, d), "filename", "rt60", 0.8, exprs.portable_key("rir_idx", SEED))


@query(f"WITH {RIRS}, {SPLIT} SELECT filename, split FROM divided")
def stratified_split(spark, d):
    return _split(spark, d)


@query(f"WITH {RIRS}, {SPLIT} SELECT family, count_if(split = 'train') AS train, count_if(split = 'test') AS test FROM divided GROUP BY 1")
def split_by_family(spark, d):
    return jobs.split_counts(views.rir_metadata(spark, d).drop("split"), _split(spark, d))


@query(f"WITH {RIRS} SELECT lower(trim(split)) AS given, CASE WHEN lower(trim(split)) = 'economy' THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM rir_metadata GROUP BY 1, 2")
def official_split(spark, d):
    given = F.lower(F.trim("split"))
    rows = views.rir_metadata(spark, d).select(given.alias("given"), F.when(given == "economy", " Test ").otherwise("validation").alias("name"))
    return rows.groupBy("given", exprs.official_split("name").alias("split")).agg(F.count("*").alias("n"))


@query(f"""WITH {RIRS}, placed AS (SELECT filename, row_number() OVER (ORDER BY {KEY.format('rir_idx')}, filename) AS k, greatest(1, CAST(floor(count(*) OVER () * 0.05) AS INT)) AS most FROM rir_metadata)
SELECT filename, CASE WHEN k <= most THEN 'val' ELSE 'train' END AS split FROM placed""")
def holdout(spark, d):
    return sampling.holdout(views.rir_metadata(spark, d), "filename", 0.05, exprs.portable_key("rir_idx", SEED))


@query("""WITH pool AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS m, count(*) OVER () AS n FROM supplier),
items AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part)
SELECT p_partkey, s_suppkey FROM items JOIN pool ON k % n = m""")
def assign_mod(spark, d):
    return sampling.assign_mod(views.table(spark, d, "part"), "p_partkey", views.table(spark, d, "supplier"), "s_suppkey")


@query(f"""WITH pool AS (SELECT n_nationkey, row_number() OVER (ORDER BY {KEY.format('n_nationkey')}, n_nationkey) - 1 AS m, count(*) OVER () AS n FROM nation)
SELECT c_custkey, n_nationkey, CAST(r.r AS INT) AS rank FROM customer, range(1, 6) r(r) JOIN pool ON ({KEY.format('c_custkey')} + r.r - 1) % n = m""")
def assign_k(spark, d):
    keys = [exprs.portable_key(k, SEED) for k in ("c_custkey", "n_nationkey")]
    return sampling.assign_k(views.table(spark, d, "customer"), "c_custkey", views.table(spark, d, "nation"), "n_nationkey", 5, *keys)


@query("SELECT s_suppkey, n_nationkey, CAST(snr AS DOUBLE) AS snr FROM supplier, nation, (VALUES (-5.0), (0.0), (10.0)) v(snr)")
def degradation_grid(spark, d):
    levels = spark.createDataFrame([(-5.0,), (0.0,), (10.0,)], "snr double")
    return sampling.degradation_grid(views.table(spark, d, "supplier").select("s_suppkey"), views.table(spark, d, "nation").select("n_nationkey"), levels)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark, d):
    ids = views.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return jobs.imported(views.table(spark, d, "labels").select(F.col("doc_id").alias("id")), ids)[1].select(F.col("id").alias("doc_id"))


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def known_ids(spark, d):
    ids = views.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    rows = views.table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    return jobs.imported(rows, ids)[0].select(F.col("id").alias("doc_id"), "quality")


@query("""SELECT p_partkey, coalesce(s_name, CASE WHEN p_brand LIKE '%1%' THEN 'circular' ELSE 'linear' END) AS family FROM part LEFT JOIN supplier ON p_partkey = s_suppkey * 3""")
def manifest_family(spark, d):
    from tessaprobe.sources.tables import with_family

    files = views.table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("wav_path"), F.when(F.col("p_brand").contains("1"), "circular").otherwise("linear").alias("family_guess"))
    manifest = views.table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("wav_path"), F.col("s_name").alias("family"))
    return with_family(files, manifest).select("p_partkey", "family")


# --- signals --------------------------------------------------------------------------------------------------------


DEALT = """utts AS (SELECT utt_id, row_number() OVER (ORDER BY utt_id) - 1 AS k, count(*) OVER () AS c FROM (SELECT DISTINCT utt_id FROM samples)),
dealt AS (SELECT a.utt_id, b.utt_id AS noise_id FROM utts a JOIN utts b ON (a.k + 1) % a.c = b.k)"""


@query(f"""WITH {SAMPLES}, noise AS (SELECT utt_id AS noise_id, i AS j, x AS y, n AS m FROM samples), levels(snr) AS (VALUES (-5.0), (0.0), (10.0)), {DEALT},
fitted AS (SELECT utt_id, noise_id, i, x, y, n FROM samples JOIN dealt USING (utt_id) JOIN noise USING (noise_id) WHERE i % m = j),
powers AS (SELECT utt_id, noise_id, sum(x * x) / any_value(n) AS ps, sum(y * y) / any_value(n) AS pn, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy FROM fitted GROUP BY 1, 2),
scaled AS (SELECT *, sqrt((ps / pow(10, snr / 10)) / (pn + 1e-12)) AS g FROM powers, levels)
SELECT utt_id, noise_id, CAST(snr AS DOUBLE) AS snr, {r('g')} AS scale, {r('xx + 2 * g * xy + g * g * yy')} AS mixed_energy FROM scaled""")
def mix_at_snr_power(spark, d):
    levels = spark.createDataFrame([(-5.0,), (0.0,), (10.0,)], "snr double")
    speech = views.signals(spark, d)
    noises = views.noises(spark, d)
    dealt = sampling.assign_mod(speech, "utt_id", noises, "noise_id", 1)
    pairs = dealt.join(speech, "utt_id").join(noises, "noise_id").crossJoin(levels)
    fitted = exprs.tiled("noise", F.size("samples"))
    out = pairs.select("utt_id", "noise_id", "snr", exprs.noise_scale("samples", fitted, F.col("snr")).alias("scale"), exprs.energy(exprs.mix_at_snr("samples", F.col("noise"), F.col("snr"))).alias("mixed_energy"))
    return rounded(out, "scale", "mixed_energy")


def window_energy(condition: str) -> str:
    return f"coalesce(sum(x * x) FILTER (WHERE {condition}), 0)"


@query(f"""WITH {RIR_SAMPLES} SELECT rir_id, {r(f"10 * log10(({window_energy('i < 50')} + 1e-10) / ({window_energy('i >= 50')} + 1e-10))")} AS c50 FROM aligned GROUP BY 1""")
def rir_c50(spark, d):
    return rounded(views.rirs(spark, d).select("rir_id", exprs.c50_from_peak("samples", RATE).alias("c50")), "c50")


@query(f"""WITH {RIR_SAMPLES}, w AS (SELECT rir_id, x, i BETWEEN p - 12 AND p + 11 AS direct FROM rirs JOIN peaks USING (rir_id))
SELECT rir_id, {r(f"10 * log10(({window_energy('direct')} + 1e-10) / ({window_energy('NOT direct')} + 1e-10))")} AS drr FROM w GROUP BY 1""")
def rir_drr(spark, d):
    return rounded(views.rirs(spark, d).select("rir_id", exprs.drr_centered("samples", 16000).alias("drr")), "drr")


def ratio_db(first: int) -> str:
    early, late = window_energy(f"i < {first}"), window_energy(f"i >= {first}")
    return r(f"CASE WHEN {late} < 1e-12 THEN 100 ELSE 10 * log10({early} / {late} + 1e-12) END")


@query(f"WITH {RIR_SAMPLES} SELECT rir_id, {ratio_db(2)} AS drr FROM aligned GROUP BY 1")
def drr_onset(spark, d):
    return rounded(views.rirs(spark, d).select("rir_id", exprs.drr_onset(exprs.onset_aligned("samples"), RATE).alias("drr")), "drr")


@query(f"WITH {RIR_SAMPLES} SELECT rir_id, {ratio_db(10)} AS c10, {ratio_db(50)} AS c50 FROM aligned GROUP BY 1")
def rir_clarity(spark, d):
    rows = views.rirs(spark, d).select("rir_id", exprs.onset_aligned("samples").alias("a"))
    return rounded(rows.select("rir_id", exprs.clarity("a", RATE, 10).alias("c10"), exprs.clarity("a", RATE, 50).alias("c50")), "c10", "c50")


@query(f"""WITH {RIR_SAMPLES}, back AS (SELECT rir_id, i, sum(x * x) OVER (PARTITION BY rir_id ORDER BY i DESC) AS e, sum(x * x) OVER (PARTITION BY rir_id) AS total FROM aligned),
db AS (SELECT rir_id, i, 10 * log10(e / (total + 1e-12) + 1e-12) AS l FROM back),
hits AS (SELECT rir_id, coalesce(min(i) FILTER (WHERE l <= -5), 0) AS a, coalesce(min(i) FILTER (WHERE l <= -25), 0) AS b, coalesce(min(i) FILTER (WHERE l <= -15), 0) AS c FROM db GROUP BY 1),
picked AS (SELECT rir_id, a, CASE WHEN a > 0 AND b > a THEN b WHEN c > a AND a > 0 THEN c END AS z, a > 0 AND b > a AS strict FROM hits),
slopes AS (SELECT p.rir_id, strict, (y.l - x.l) / ((z - a) / 1000.0) AS s FROM picked p LEFT JOIN db x ON p.rir_id = x.rir_id AND x.i = a LEFT JOIN db y ON p.rir_id = y.rir_id AND y.i = z)
SELECT rir_id, {r("CASE WHEN s IS NULL OR abs(s) < 1e-6 OR (strict AND -60 / s <= 0) THEN -1 ELSE -60 / s END")} AS rt60 FROM slopes""")
def rir_rt60(spark, d):
    return rounded(views.rirs(spark, d).select("rir_id", signal.rt60(exprs.onset_aligned("samples"), RATE).alias("rt60")), "rt60")


@query(f"""WITH {RIR_SAMPLES}, e AS (SELECT rir_id, {window_energy('i < 20')} AS early, {window_energy('i >= 20')} AS late FROM aligned GROUP BY 1), levels(c) AS (VALUES (-5.0), (10.0), (25.0))
SELECT rir_id, CAST(c AS DOUBLE) AS target_c50, {r("CASE WHEN late < 1e-10 THEN 1e-10 WHEN early < 1e-10 THEN 1e6 ELSE greatest(1e-10, least(1e6, sqrt(early / (pow(10, c / 10) * late + 1e-10)))) END")} AS ratio FROM e, levels""")
def target_c50_ratio(spark, d):
    levels = F.explode(F.array(F.lit(-5.0), F.lit(10.0), F.lit(25.0))).alias("target_c50")
    rows = views.rirs(spark, d).select("rir_id", exprs.onset_aligned("samples").alias("a"), levels)
    return rounded(rows.select("rir_id", "target_c50", exprs.target_c50_ratio("a", F.col("target_c50"), 20).alias("ratio")), "ratio")


@query(f"""WITH {SAMPLES}, sizes AS (SELECT DISTINCT utt_id, n FROM samples),
whole AS (SELECT utt_id, unnest(range(0, greatest(n // 20, 1))) * 20 AS chunk_start FROM sizes), tails AS (SELECT utt_id, n - 20 AS chunk_start FROM sizes WHERE n > 20 AND n % 20 <> 0)
SELECT c.utt_id, CAST(chunk_start AS BIGINT) AS chunk_start, {r('sum(x)')} AS total FROM (SELECT * FROM whole UNION ALL SELECT * FROM tails) c
JOIN samples s ON s.utt_id = c.utt_id AND s.i >= chunk_start AND s.i < chunk_start + 20 GROUP BY 1, 2""")
def chunk_index(spark, d):
    out = signal.chunked(views.signals(spark, d), "samples", 20)
    return rounded(out.select("utt_id", F.col("chunk_start").cast("bigint").alias("chunk_start"), exprs.total("chunk").alias("total")), "total")


@query(f"WITH {SAMPLES} SELECT utt_id, {r('sqrt(any_value(n) / sum(x * x))')} AS gain, {r('max(abs(x))')} AS peak FROM samples GROUP BY 1")
def rms_gain(spark, d):
    return rounded(views.signals(spark, d).select("utt_id", exprs.rms_gain("samples").alias("gain"), F.array_max(F.transform("samples", F.abs)).alias("peak")), "gain", "peak")


@query(f"""WITH {SAMPLES}, pairs AS (SELECT a.utt_id, a.x AS r, b.x AS e FROM samples a JOIN samples b ON b.utt_id = a.utt_id + 1 AND a.i = b.i),
c AS (SELECT *, r - avg(r) OVER (PARTITION BY utt_id) AS rc, e - avg(e) OVER (PARTITION BY utt_id) AS ec FROM pairs),
s AS (SELECT utt_id, sum(r * e) AS re, sum(r * r) AS rr, sum(e * e) AS ee, sum(rc * ec) AS cre, sum(rc * rc) AS crr, sum(ec * ec) AS cee FROM c GROUP BY 1),
a AS (SELECT *, re / (rr + 1e-10) AS g, cre / (crr + 1e-8) AS cg FROM s)
SELECT utt_id, {r('10 * log10((g * g * rr + 1e-10) / (ee - 2 * g * re + g * g * rr + 1e-10))')} AS plain,
 {r('10 * log10(cg * cg * crr / (cee - 2 * cg * cre + cg * cg * crr + 1e-8))')} AS centred FROM a""")
def si_sdr_pairs(spark, d):
    a = views.signals(spark, d)
    b = a.select((F.col("utt_id") - 1).alias("utt_id"), F.col("samples").alias("estimate"))
    out = a.join(b, "utt_id").select("utt_id", exprs.si_sdr("samples", "estimate").alias("plain"), exprs.si_sdr("samples", "estimate", True, 1e-8).alias("centred"))
    return rounded(out, "plain", "centred")


@query(f"""WITH {SAMPLES}, places AS (SELECT DISTINCT utt_id, n, unnest(range(0, greatest(n, 200))) AS k FROM samples)
SELECT utt_id, count(*) AS n, {r('sum(x * (k + 1))')} AS weighted FROM places JOIN samples USING (utt_id) WHERE i = k % samples.n GROUP BY 1""")
def loop_pad(spark, d):
    rows = views.signals(spark, d).select("utt_id", exprs.loop_padded("samples", 200).alias("p"))
    weighted = exprs.total(F.transform("p", lambda x, i: x * (i + 1)))
    return rounded(rows.select("utt_id", F.size("p").cast("bigint").alias("n"), weighted.alias("weighted")), "weighted")


@query(f"WITH {SAMPLES} SELECT utt_id, {r('sum(x)')} AS total, count(*) AS n FROM samples GROUP BY 1")
def chunk_stitch(spark, d):
    waves = views.signals(spark, d).withColumn("n", F.size("samples"))
    out = signal.stitched(signal.chunked(waves, "samples", 20).drop("samples"), ["utt_id"], "n", 20)
    cut = F.slice("samples", F.lit(1), F.size("samples"))
    return rounded(out.select("utt_id", exprs.total(cut).alias("total"), F.size("samples").cast("bigint").alias("n")), "total")


# --- representations ------------------------------------------------------------------------------------------------

CALLS = f"""WITH {TOKENS}, a AS (SELECT layer, (token_idx - 1) // 16 AS call_idx, token_idx % 4 AS time_idx, ((token_idx - 1) // 4) % 4 AS token, i, v FROM tokens)"""


def _calls(spark, d):
    k = F.col("token_idx") - 1
    return views.tokens(spark, d).select(
        "layer", F.floor(k / 16).cast("int").alias("call_idx"), (F.col("token_idx") % 4).alias("time_idx"), (F.floor(k / 4) % 4).cast("int").alias("token_idx"), "vec"
    )


def _vector_rows(df, key):
    return rounded(df.select("layer", F.col("token_idx").cast("bigint").alias(key), F.posexplode("vec").alias("p", "value")).select("layer", key, (F.col("p") + 1).cast("bigint").alias("i"), "value"), "value")


@query(f"{CALLS} SELECT layer, token AS token, i, {r('avg(v)')} AS value FROM a WHERE call_idx = 0 GROUP BY ALL")
def pool_first(spark, d):
    return _vector_rows(represent.pool_first(_calls(spark, d), ["layer"]), "token")


@query(f"{CALLS}, m AS (SELECT *, max(call_idx) OVER (PARTITION BY layer) AS last FROM a) SELECT layer, token, i, {r('avg(v)')} AS value FROM m WHERE call_idx < last OR last = 0 GROUP BY ALL")
def pool_drop_last(spark, d):
    return _vector_rows(represent.pool_drop_last(_calls(spark, d), ["layer"]), "token")


@query(f"{CALLS}, c AS (SELECT layer, call_idx, token, i, avg(v) AS v FROM a GROUP BY ALL) SELECT layer, token, i, {r('avg(v)')} AS value FROM c GROUP BY ALL")
def pool_mean_of_means(spark, d):
    return _vector_rows(represent.pool_mean_of_means(_calls(spark, d), ["layer"]), "token")


@query(f"{CALLS}, k AS (SELECT layer, dense_rank() OVER (PARTITION BY layer ORDER BY call_idx, time_idx, token) - 1 AS token, i, v FROM a) SELECT layer, token, i, {r('v')} AS value FROM k")
def pool_concat(spark, d):
    calls = _calls(spark, d).withColumn("time_idx", F.col("time_idx") * 4 + F.col("token_idx"))
    return _vector_rows(represent.pool_concat(calls, ["layer"]), "token")


@query("""WITH e AS (SELECT label AS layer, vec_id % 5 AS part, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT layer, part, i, round(avg(v), 6) + 0.0 AS value, count(*) AS n_samples FROM e GROUP BY ALL""")
def centroids(spark, d):
    rows = represent.centroids(views.all_vectors(spark, d).withColumn("part", F.col("vec_id") % 5), ["layer", "part"])
    out = rows.select("layer", "part", "n_samples", F.posexplode("vec").alias("p", "value"))
    return rounded(out.select("layer", "part", (F.col("p") + 1).cast("bigint").alias("i"), "value", "n_samples"), "value")


CKA = f"""WITH {TOKENS}, n AS (SELECT count(DISTINCT layer) AS n FROM tokens),
every AS (SELECT layer, token_idx, i, v, 0 AS s FROM tokens UNION ALL SELECT CAST((layer + n - 1) % n AS INT) AS layer, token_idx, i, v, 1 FROM tokens, n),
sides AS (SELECT * FROM every SEMI JOIN (SELECT layer, token_idx FROM every GROUP BY 1, 2 HAVING count(DISTINCT s) = 2) USING (layer, token_idx)),
c AS (SELECT *, v - avg(v) OVER (PARTITION BY layer, s, i) AS z FROM sides),
g AS (SELECT a.layer, a.s AS s, b.s AS t, a.i, b.i AS j, sum(a.z * b.z) AS w FROM c a JOIN c b USING (layer, token_idx) WHERE a.s <= b.s GROUP BY ALL),
q AS (SELECT layer, sum(w * w) FILTER (WHERE s = 0 AND t = 1) AS xy, sum(w * w) FILTER (WHERE s = 0 AND t = 0) AS xx, sum(w * w) FILTER (WHERE s = 1 AND t = 1) AS yy FROM g GROUP BY 1)
SELECT layer, {r('greatest(0, least(1, xy / (sqrt(xx) * sqrt(yy) + 1e-12)))')} AS CKA FROM q"""


def _pairs(spark, d):
    x = views.tokens(spark, d).select("layer", "token_idx", "vec")
    n = x.select("layer").distinct().count()
    y = x.withColumn("layer", ((F.col("layer") + n - 1) % n).cast("int"))
    keys = ["layer", "token_idx"]  # labels differ in size: only the tokens that both have go in
    return represent.paired(x.join(y, keys, "left_semi"), y.join(x, keys, "left_semi"), ["layer"])


@query(CKA)
def cka(spark, d):
    return rounded(represent.cka(_pairs(spark, d), ["layer"]), "CKA")


@query(CKA)
def cka_relational(spark, d):
    return rounded(represent.cka_relational(_pairs(spark, d), ["layer"]), "CKA")


@query(CKA)
def cka_moments(spark, d):
    return rounded(represent.cka_moments(_pairs(spark, d), ["layer"]), "CKA")


# --- diffusion maps -------------------------------------------------------------------------------------------------

D2 = f"WITH {TOKENS}, d2 AS (SELECT a.layer, a.token_idx AS i, b.token_idx AS j, sum((a.v - b.v) ** 2) AS d2 FROM tokens a JOIN tokens b ON a.layer = b.layer AND a.i = b.i AND a.token_idx < b.token_idx GROUP BY ALL)"
EPS = f"{D2}, eps AS (SELECT layer, greatest(quantile_disc(d2, 0.5), 1.1920928955078125e-07) AS eps FROM d2 GROUP BY 1)"
KERNEL = f"""{EPS}, half AS (SELECT layer, i, j, exp(-d2 / (2 * eps)) AS k FROM d2 JOIN eps USING (layer)),
k AS (SELECT * FROM half UNION ALL SELECT layer, j, i, k FROM half UNION ALL SELECT DISTINCT layer, token_idx, token_idx, 1.0 FROM tokens),
deg AS (SELECT layer, i, sum(k) AS d FROM k GROUP BY 1, 2)"""
KSYM = f"{KERNEL}, m AS (SELECT k.layer, k.i, k.j, k / sqrt(a.d * b.d) AS m FROM k JOIN deg a ON a.layer = k.layer AND a.i = k.i JOIN deg b ON b.layer = k.layer AND b.i = k.j)"


def _points(spark, d):
    return views.tokens(spark, d).select("layer", F.col("token_idx").cast("bigint").alias("i"), "vec")


@query(f"{D2} SELECT layer, i, j, {r('d2')} AS d2 FROM d2")
def pairwise_d2(spark, d):
    return kernels.distances(_points(spark, d), "layer", "i", "vec", finish=kernels.half_up(6))


@query(f"{D2} SELECT layer, i, j, {r('d2')} AS d2 FROM d2")
def pairwise_blocks(spark, d):
    """The same from blocks that are smaller than a layer at every size."""
    return kernels.distances(_points(spark, d), "layer", "i", "vec", block=16, finish=kernels.half_up(6))


@query(f"{EPS} SELECT layer, {r('eps')} AS eps FROM eps")
def bandwidth(spark, d):
    return rounded(kernels.bandwidth(kernels.packed(_points(spark, d), "layer", "i", "vec"), "layer"), "eps")


@query(f"{KERNEL} SELECT layer, i, {r('d')} AS d FROM deg")
def kernel_degree(spark, d):
    return rounded(kernels.degrees(_points(spark, d), "layer", "i", "vec").select("layer", "i", "d"), "d")


@query(f"{KSYM} SELECT layer, i, j, {r('m')} AS m FROM m")
def ksym(spark, d):
    return kernels.symmetric_pairs(kernels.degrees(_points(spark, d), "layer", "i", "vec"), "layer", "i", finish=kernels.half_up(6))


@query(f"""{KERNEL}, n AS (SELECT k.layer, k.i, k.j, k / (sqrt(a.d) * sqrt(b.d)) AS k FROM k JOIN deg a ON a.layer = k.layer AND a.i = k.i JOIN deg b ON b.layer = k.layer AND b.i = k.j)
SELECT layer, i, {r('sum(k)')} AS d FROM n GROUP BY 1, 2""")
def alpha_degree(spark, d):
    return rounded(kernels.degrees(_points(spark, d), "layer", "i", "vec", alpha=0.5).select("layer", "i", "d"), "d")


@query(f"{KERNEL} SELECT layer, {r('1 / sqrt(min(d) / sum(d)) / ln(2)')} AS c_value FROM deg GROUP BY 1")
def mixing_c(spark, d):
    return rounded(kernels.mixing_constant(kernels.degrees(_points(spark, d), "layer", "i", "vec"), "layer"), "c_value")


DIST_ONE = f"""{KSYM}, s AS (SELECT a.layer, a.i, b.j, sum(a.m * b.m) AS s FROM m a JOIN m b ON a.layer = b.layer AND a.j = b.i GROUP BY ALL), t AS (SELECT layer, sum(d) AS total FROM deg GROUP BY 1)
SELECT s.layer, s.i, s.j, {r('p.s + q.s - 2 * s.s - (sqrt(a.d) - sqrt(b.d)) ** 2 / total')} AS dist2 FROM s JOIN s p ON p.layer = s.layer AND p.i = s.i AND p.j = s.i
JOIN s q ON q.layer = s.layer AND q.i = s.j AND q.j = s.j JOIN deg a ON a.layer = s.layer AND a.i = s.i JOIN deg b ON b.layer = s.layer AND b.i = s.j JOIN t ON t.layer = s.layer WHERE s.i < s.j"""


@query(DIST_ONE)
def diffusion_dist_t1(spark, d):
    return kernels.diffusion_distance_one(_points(spark, d), "layer", "i", "vec", finish=kernels.half_up(6))


@query(f"""{KERNEL},
m AS (SELECT k.layer, k.i, k.j, k / sqrt(a.d * b.d) AS m FROM k JOIN deg a ON a.layer = k.layer AND a.i = k.i JOIN deg b ON b.layer = k.layer AND b.i = k.j),
m2 AS (SELECT a.layer, a.i, b.j, sum(a.m * b.m) AS m FROM m a JOIN m b ON a.layer = b.layer AND a.j = b.i GROUP BY ALL),
m4 AS (SELECT a.layer, a.i, b.j, sum(a.m * b.m) AS m FROM m2 a JOIN m2 b ON a.layer = b.layer AND a.j = b.i GROUP BY ALL),
s AS (SELECT a.layer, a.i, b.j, sum(a.m * b.m) AS s FROM m4 a JOIN m4 b ON a.layer = b.layer AND a.j = b.i GROUP BY ALL), t AS (SELECT layer, sum(d) AS total FROM deg GROUP BY 1)
SELECT s.layer, s.i, s.j, {r('1000 * (p.s + q.s - 2 * s.s - (sqrt(a.d) - sqrt(b.d)) ** 2 / total)')} AS dist2 FROM s JOIN s p ON p.layer = s.layer AND p.i = s.i AND p.j = s.i
JOIN s q ON q.layer = s.layer AND q.i = s.j AND q.j = s.j JOIN deg a ON a.layer = s.layer AND a.i = s.i JOIN deg b ON b.layer = s.layer AND b.i = s.j JOIN t ON t.layer = s.layer WHERE s.i < s.j""")
def diffusion_leading_distances(spark, d):
    """A thousand times the squared diffusion distances at time 4 of whole vectors, by as many directions as the kernel's fourth power has; the others' share is below 1e-12."""
    return manifold.power_distances(_points(spark, d), "layer", "i", "vec", 4, finish=kernels.half_up(6, 1000.0))


@query(f"""{KSYM}, s AS (SELECT layer, CAST(count_if(i = j) AS INT) AS n, sum(m) FILTER (WHERE i = j) AS trace, sum(m * m) AS frobenius FROM m GROUP BY 1) SELECT layer, n, {r('trace - 1')} AS eigen_sum, {r('frobenius - 1')} AS eigen_squares FROM s""")
def diffusion_eigenvalues(spark, d):
    """Sums over the eigenvalues of each layer's map: the trace and the squared norm of the kernel give the same."""
    return rounded(manifold.eigenvalue_sums(_points(spark, d), "layer", "i", "vec"), "eigen_sum", "eigen_squares")


@query(f"""WITH {PROBE}, v AS (SELECT model_name, layer, sum(CKA) AS lam FROM probe_facts GROUP BY 1, 2),
s AS (SELECT model_name, sum(lam) OVER (PARTITION BY model_name ORDER BY lam DESC, layer ROWS UNBOUNDED PRECEDING) / sum(lam) OVER (PARTITION BY model_name) AS share FROM v)
SELECT model_name, count_if(share < 0.7) + 1 AS n_components FROM s GROUP BY 1""")
def energy_cutoff(spark, d):
    values = views.probe_facts(spark, d).groupBy("model_name", "layer").agg(F.sum("CKA").alias("lam"))
    w = Window.partitionBy("model_name").orderBy(F.desc("lam"), "layer")
    return manifold.energy_cutoff(values.withColumn("k", F.row_number().over(w)), ["model_name"], "k", "lam", 0.7)


DIST = f"WITH {PSI}, ref AS (SELECT layer, i, x AS y FROM psi WHERE snr = (SELECT max(snr) FROM psi)), dist AS (SELECT layer, snr, sqrt(sum((x - y) ** 2)) AS dist FROM psi LEFT JOIN ref USING (layer, i) GROUP BY 1, 2)"


@query(f"{DIST} SELECT layer, snr, {r('dist')} AS dist FROM dist")
def ref_distance(spark, d):
    return rounded(manifold.distance_from_reference(views.psi_table(spark, d)).select("layer", "snr", "dist"), "dist")


LAYERS = f"""WITH {PSI}, grid AS (SELECT s.snr, a.layer AS layer_i, b.layer AS layer_j FROM (SELECT DISTINCT snr FROM psi) s, (SELECT DISTINCT layer FROM psi) a, (SELECT DISTINCT layer FROM psi) b),
found AS (SELECT a.snr, a.layer AS layer_i, b.layer AS layer_j, sqrt(sum((a.x - b.x) ** 2)) AS dist FROM psi a JOIN psi b ON a.snr = b.snr AND a.i = b.i GROUP BY 1, 2, 3),
dist AS (SELECT * FROM grid LEFT JOIN found USING (snr, layer_i, layer_j))"""


@query(f"{LAYERS} SELECT snr, layer_i, layer_j, {r('dist')} AS dist FROM dist")
def layer_distance(spark, d):
    return rounded(manifold.layer_distances(views.psi_table(spark, d)), "dist")


@query(f"""{LAYERS}, m AS (SELECT *, min(dist) OVER (PARTITION BY snr) AS low, max(dist) OVER (PARTITION BY snr) AS high FROM dist)
SELECT snr, layer_i, layer_j, {r('CASE WHEN dist IS NULL THEN NULL WHEN high > low THEN (dist - low) / (high - low) ELSE 0 END')} AS scaled FROM m""")
def layer_distance_norm(spark, d):
    return rounded(jobs.distance_slices(views.psi_table(spark, d)).select("snr", "layer_i", "layer_j", "scaled"), "scaled")


@query(f"""{DIST}, k AS (SELECT layer, dist AS y, snr AS x, rank() OVER (PARTITION BY layer ORDER BY dist) + (count(*) OVER (PARTITION BY layer, dist) - 1) / 2.0 AS ry,
 rank() OVER (PARTITION BY layer ORDER BY snr) AS rx FROM dist) SELECT layer, {FIT}, {r(corr('ry', 'rx'))} AS rho FROM k GROUP BY 1""")
def monotonicity(spark, d):
    return rounded(jobs.diffusion_monotonicity(views.psi_table(spark, d)), "slope", "intercept", "r2", "rho")


# --- evaluation and data quality --------------------------------------------------------------------------------------

MEANS = {c: f"avg(CASE WHEN {c} > 0 THEN {c} END)" for c in ("pesq", "pesq_input")}


@query(f"""WITH {EVALS} SELECT domain, {r(MEANS['pesq'])} AS pesq, {r(MEANS['pesq_input'])} AS pesq_input, {r(MEANS['pesq'] + ' - ' + MEANS['pesq_input'])} AS pesq_delta,
 {r('avg(si_sdr)')} AS si_sdr, {r('avg(si_sdr_input)')} AS si_sdr_input, {r('avg(si_sdr) - avg(si_sdr_input)')} AS si_sdr_delta, count(*) AS n FROM eval_scores GROUP BY 1""")
def eval_summary(spark, d):
    out = evaluation.summary(views.eval_scores(spark, d))
    return rounded(out, *[c for c in out.columns if c not in ("domain", "n")])


@query(f"""WITH {EVALS}, b AS (SELECT *, CASE WHEN rt60 < 0 THEN NULL WHEN rt60 < 0.3 THEN '0.0-0.3' WHEN rt60 < 0.5 THEN '0.3-0.5' WHEN rt60 < 0.8 THEN '0.5-0.8' WHEN rt60 < 1.5 THEN '0.8-1.5' END AS bin FROM eval_scores)
SELECT bin, {r(MEANS['pesq'])} AS pesq, {r('avg(si_sdr)')} AS si_sdr, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY 1""")
def eval_by_rt60(spark, d):
    return rounded(evaluation.by_rt60(views.eval_scores(spark, d)), "pesq", "si_sdr")


@query(f"""WITH {PROBE} SELECT count(DISTINCT layer) AS n_layer, count(DISTINCT noise_name) AS n_noise_name, count(DISTINCT snr) AS n_snr, count(*) AS n_rows,
 count(DISTINCT (layer, noise_name, snr)) AS n_cells, count(DISTINCT layer) * count(DISTINCT noise_name) * count(DISTINCT snr) AS n_grid FROM probe_facts""")
def completeness(spark, d):
    return evaluation.completeness(views.probe_facts(spark, d), "layer", "noise_name", "snr")


@query(f"""WITH {REVERB}, a AS (SELECT DISTINCT model_name, layer, target_c50, rir_name FROM reverb_facts),
g AS (SELECT * FROM (SELECT DISTINCT model_name FROM a), (SELECT DISTINCT layer FROM a), (SELECT DISTINCT target_c50 FROM a), (SELECT DISTINCT rir_name FROM a)) SELECT * FROM g EXCEPT SELECT * FROM a""")
def missing_cells(spark, d):
    return evaluation.missing_cells(views.reverb_facts(spark, d), "model_name", "layer", "target_c50", "rir_name")


@query(f"""WITH {PROBE} SELECT layer, {r('min(CKA)')} AS least, {r('max(CKA)')} AS largest, count_if(CKA IS NULL OR isnan(CKA)) AS n_invalid, count_if(CKA < 0 OR CKA > 1) AS n_outside FROM probe_facts GROUP BY 1""")
def quality_bounds(spark, d):
    return rounded(evaluation.bounds(views.probe_facts(spark, d), ["layer"], "CKA"), "least", "largest")


@query(f"WITH {PROBE}, m AS (SELECT layer, noise_name, avg(CKA) AS m FROM probe_facts GROUP BY 1, 2) SELECT layer, {r('stddev_samp(m)')} AS spread, count(*) AS n_noises FROM m GROUP BY 1")
def noise_structure(spark, d):
    return rounded(evaluation.noise_structure(views.probe_facts(spark, d), ["layer"], "noise_name", "CKA"), "spread")


@query(f"""WITH {RIRS} SELECT family, {r('avg(CASE WHEN rt60 > 0 THEN rt60 END)')} AS mean_rt60, {r('median(CASE WHEN rt60 > 0 THEN rt60 END)')} AS median_rt60, {r('min(CASE WHEN rt60 > 0 THEN rt60 END)')} AS min_rt60,
 {r('max(CASE WHEN rt60 > 0 THEN rt60 END)')} AS max_rt60, count_if(rt60 < 0) AS n_invalid, count(*) AS n FROM rir_metadata GROUP BY 1""")
def rir_summary(spark, d):
    return rounded(evaluation.rir_summary(views.rir_metadata(spark, d)), "mean_rt60", "median_rt60", "min_rt60", "max_rt60")


@query(f"""WITH {EVALS}, w AS (SELECT *, min(pesq) OVER (PARTITION BY domain, utterance_id % 8) AS low FROM eval_scores)
SELECT utterance_id, {r('CASE WHEN low = -1 THEN NULL ELSE (pesq - 1) / 3.5 END')} AS unit, {r('(0.06 * si_sdr + 1.3) * si_sdr - 0.5')} AS mos FROM w""")
def score_scaling(spark, d):
    low = F.min("pesq").over(Window.partitionBy("domain", F.col("utterance_id") % 8))
    rows = views.eval_scores(spark, d).withColumn("low", low)
    return rounded(rows.select("utterance_id", exprs.pesq_unit("pesq", F.col("low")).alias("unit"), exprs.polynomial("si_sdr", (0.06, 1.3, -0.5)).alias("mos")), "unit", "mos")


@query(DIST_ONE)
def diffusion_psi_distances(spark, d):
    """Squared distances between the points' diffusion coordinates at time 1 with all components."""
    return manifold.psi_distances(_points(spark, d), "layer", "i", "vec", finish=kernels.half_up(6))


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from tessaprobe.plans import grid, studies  # register their queries as they are imported

    assert studies and grid
    return _found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
