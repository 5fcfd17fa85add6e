"""Registered queries of the jobs that take a user's model: similarity over the degradation grid, noisy and enhanced scores, training pairs.

The stand-in model is small and deterministic, so that SQL can follow it: its tokens are means of two frames of four samples, as they are
and squared; its enhanced signal is the mean of neighbouring samples, with two samples too many at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaprobe.functions import exprs
from tessaprobe.operators import represent, signal
from tessaprobe.plans import jobs, views
from tessaprobe.plans.registry import query, r, rounded
from tessaprobe.plans.views import RIR_SAMPLES, SAMPLES

FRAME = 4
TOKENS = "layer string, call_idx int, time_idx int, token_idx int, vec array<double>"


def frames_of(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of a signal, and their numbers."""
    frames = np.asarray(samples, np.float64)[: len(samples) // FRAME * FRAME].reshape(-1, FRAME)
    return frames, np.arange(len(frames))


SAMPLES_AT_ONCE = 1 << 18


def token_rows(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Rows (keys, TOKENS) of a batch of waves (keys, samples)."""
    cut = [frames_of(x) for x in frame["samples"]]
    frames = np.concatenate([x for x, _ in cut]) if cut else np.empty((0, FRAME))
    at = np.concatenate([n for _, n in cut]) if cut else np.empty(0, np.int64)
    waves = np.repeat(np.arange(len(frame)), [len(n) for _, n in cut])
    own = frame[keys].iloc[waves].reset_index(drop=True).assign(call_idx=0, time_idx=at % 2, token_idx=at // 2)
    parts = [own.assign(layer=layer, vec=list(values)) for layer, values in (("plain", frames), ("square", frames**2))]
    return pd.concat(parts, ignore_index=True)[[*keys, "layer", "call_idx", "time_idx", "token_idx", "vec"]]


def grid_tokens(frames):
    for frame in frames:
        keys = [c for c in frame.columns if c != "samples"]
        for _, part in frame.groupby(np.cumsum(frame["samples"].map(len).to_numpy()) // SAMPLES_AT_ONCE):
            yield token_rows(part, keys)


def noise_pool(spark, d) -> DataFrame:
    """noise_name, samples: per kind of event the mean value by event_id mod 32, in this order."""
    means = views.table(spark, d, "events").groupBy(F.col("event_type").alias("noise_name"), (F.col("event_id") % 32).alias("j")).agg(F.avg("value").alias("y"))
    return means.groupBy("noise_name").agg(F.sort_array(F.collect_list(F.struct("j", "y"))).alias("p")).select("noise_name", F.col("p.y").alias("samples"))


NOISE = """pool AS (SELECT noise_name, row_number() OVER (PARTITION BY noise_name ORDER BY j) - 1 AS j, count(*) OVER (PARTITION BY noise_name) AS m, y
 FROM (SELECT event_type AS noise_name, event_id % 32 AS j, avg(value) AS y FROM events GROUP BY 1, 2))"""
#: From degraded samples (utt_id, CONDITIONS, i, n, v) and clean ones to the similarity of their tokens.
COMPARED = f"""every AS (SELECT utt_id, NULL AS kind, CAST(NULL AS DOUBLE) AS level, i, n, x AS v FROM samples UNION ALL SELECT utt_id, kind, level, i, n, v FROM degraded),
layers AS (SELECT utt_id, kind, level, 'plain' AS layer, i // 8 AS token, i % 4 AS c, v FROM every WHERE i < n // 4 * 4 UNION ALL SELECT utt_id, kind, level, 'square', i // 8, i % 4, v * v FROM every WHERE i < n // 4 * 4),
pooled AS (SELECT utt_id, kind, level, layer, token, c, avg(v) AS v FROM layers GROUP BY ALL),
z AS (SELECT *, v - avg(v) OVER (PARTITION BY utt_id, kind, level, layer, c) AS z FROM pooled),
x AS (SELECT * FROM z WHERE kind IS NULL), y AS (SELECT * FROM z WHERE kind IS NOT NULL),
xy AS (SELECT utt_id, kind, level, layer, sum(w * w) AS w FROM (SELECT y.utt_id, y.kind, y.level, y.layer, sum(x.z * y.z) AS w FROM x JOIN y ON x.utt_id = y.utt_id AND x.layer = y.layer AND x.token = y.token GROUP BY y.utt_id, y.kind, y.level, y.layer, x.c, y.c) GROUP BY ALL),
xx AS (SELECT utt_id, layer, sum(w * w) AS w FROM (SELECT a.utt_id, a.layer, sum(a.z * b.z) AS w FROM x a JOIN x b ON a.utt_id = b.utt_id AND a.layer = b.layer AND a.token = b.token GROUP BY a.utt_id, a.layer, a.c, b.c) GROUP BY ALL),
yy AS (SELECT utt_id, kind, level, layer, sum(w * w) AS w FROM (SELECT a.utt_id, a.kind, a.level, a.layer, sum(a.z * b.z) AS w FROM y a JOIN y b ON a.utt_id = b.utt_id AND a.kind = b.kind AND a.level = b.level AND a.layer = b.layer AND a.token = b.token GROUP BY a.utt_id, a.kind, a.level, a.layer, a.c, b.c) GROUP BY ALL),
likeness AS (SELECT xy.utt_id, xy.kind, xy.level, xy.layer, {r('greatest(0, least(1, xy.w / (sqrt(xx.w) * sqrt(yy.w) + 1e-12)))')} AS CKA
 FROM xy JOIN xx ON xy.utt_id = xx.utt_id AND xy.layer = xx.layer JOIN yy ON xy.utt_id = yy.utt_id AND xy.kind = yy.kind AND xy.level = yy.level AND xy.layer = yy.layer)"""


@query(f"""WITH {SAMPLES}, {NOISE}, levels(level) AS (VALUES (-5.0::DOUBLE), (0.0), (20.0)),
fitted AS (SELECT utt_id, noise_name, i, n, x, y FROM samples s JOIN pool ON s.i % m = j),
powers AS (SELECT utt_id, noise_name, avg(x * x) AS ps, avg(y * y) AS pn FROM fitted GROUP BY 1, 2),
degraded AS (SELECT utt_id, noise_name AS kind, level, i, n, x + y * sqrt((ps / pow(10, level / 10)) / (pn + 1e-12)) AS v FROM fitted JOIN powers USING (utt_id, noise_name), levels), {COMPARED}
SELECT utt_id, kind AS noise_name, level, layer, CKA FROM likeness""")
def cka_grid(spark, d):
    """Every signal under every noise at every level, through the model, against the clean signal."""
    schema = f"utt_id bigint, noise_name string, level double, {TOKENS}"
    return rounded(jobs.cka_table(views.signals(spark, d), noise_pool(spark, d), (-5.0, 0.0, 20.0), grid_tokens, schema, keys=("layer",)), "CKA")


@query(f"""WITH {SAMPLES}, {NOISE}, raw AS (SELECT noise_name, j, y / (1 + j) AS h FROM pool), peaks AS (SELECT noise_name, min(j) AS p FROM (SELECT *, max(abs(h)) OVER (PARTITION BY noise_name) AS top FROM raw) WHERE abs(h) = top GROUP BY 1),
cut AS (SELECT noise_name, j - p AS j, h FROM raw JOIN peaks USING (noise_name) WHERE j >= p), sums AS (SELECT noise_name, sum(h * h) FILTER (WHERE j < 6) AS e, coalesce(sum(h * h) FILTER (WHERE j >= 6), 0) AS late FROM cut GROUP BY 1),
targets(level) AS (VALUES (0.0::DOUBLE), (12.5)), scaled AS (SELECT noise_name, level, j, CASE WHEN j < 6 THEN h WHEN late < 1e-10 THEN h * 1e-10 WHEN e < 1e-10 THEN h * 1e6 ELSE h * greatest(1e-10, least(1e6, sqrt(e / (pow(10, level / 10) * late + 1e-10)))) END AS h
 FROM cut JOIN sums USING (noise_name), targets), degraded AS (SELECT utt_id, noise_name AS kind, level, i + j AS i, any_value(n) AS n, sum(x * h) AS v FROM samples, scaled WHERE i + j < n GROUP BY utt_id, noise_name, level, i + j), {COMPARED}
SELECT utt_id, kind AS rir_name, level AS target_c50, layer, CKA FROM likeness""")
def cka_reverb_grid(spark, d):
    """Every signal through every response at every target, with an early part of six samples."""
    rirs = noise_pool(spark, d).select(F.col("noise_name").alias("rir_name"), F.transform("samples", lambda x, i: x / (1 + i)).alias("samples"))
    schema = f"utt_id bigint, rir_name string, target_c50 double, {TOKENS}"
    return rounded(jobs.cka_reverb_table(views.signals(spark, d), rirs, (0.0, 12.5), grid_tokens, schema, keys=("layer",), early=6), "CKA")


def enhancer(frame: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Token rows and enhanced signals of a batch."""
    better = []
    for x in frame["samples"]:
        x = np.asarray(x, np.float64)
        better.append(np.append((x + np.concatenate([[0.0], x[:-1]])) / 2, [9.0, 9.0]) if len(x) else x)
    return token_rows(frame, ["utt_id"]), frame[["utt_id"]].assign(enhanced=better)


def mean_gap(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.abs(x - y).mean())


def _side(name: str, xy: str, yy: str) -> str:
    re = f"({xy} / (xx + 1e-10))"
    return r(f"10 * log10(({re} ** 2 * xx + 1e-10) / ({yy} - 2 * {re} * {xy} + {re} ** 2 * xx + 1e-10))") + f" AS {name}"


@query(f"""WITH {SAMPLES}, pairs AS (SELECT a.utt_id, a.i, a.x, a.x + b.x / 4 AS y FROM samples a JOIN samples b ON b.utt_id = a.utt_id + 1 AND a.i = b.i),
sides AS (SELECT *, (y + coalesce(lag(y) OVER (PARTITION BY utt_id ORDER BY i), 0)) / 2 AS z FROM pairs),
sums AS (SELECT utt_id, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(x * z) AS xz, sum(z * z) AS zz, avg(abs(x - y)) AS gap_y, avg(abs(x - z)) AS gap_z, count(*) AS n FROM sides GROUP BY 1)
SELECT utt_id, n, n // 4 * 2 AS n_rows, {_side('noisy_si_sdr', 'xy', 'yy')}, {_side('enhanced_si_sdr', 'xz', 'zz')}, {r('gap_y')} AS noisy_gap, {r('gap_z')} AS enhanced_gap FROM sums""")
def noisy_and_enhanced(spark, d):
    """One pass of the model gives activation rows and enhanced signals; one pass of the scorer both sides' scores."""
    waves = views.signals(spark, d)
    following = waves.select((F.col("utt_id") - 1).alias("utt_id"), F.col("samples").alias("next"))
    n = F.least(F.size("samples"), F.size("next"))
    noisy = waves.join(following, "utt_id").select("utt_id", F.slice("samples", F.lit(1), n).alias("clean"), F.zip_with(F.slice("samples", F.lit(1), n), F.slice("next", F.lit(1), n), lambda x, y: x + y / 4).alias("samples"))
    rows, enhanced = represent.extract_with_enhanced(noisy, enhancer, f"utt_id bigint, {TOKENS}", ["utt_id"])
    both = noisy.withColumnRenamed("samples", "noisy").join(enhanced, "utt_id").join(rows.groupBy("utt_id").agg(F.count("*").alias("n_rows")), "utt_id")
    scores = signal.score_sides(both, {"gap": mean_gap}, "clean", {"noisy": "noisy_{}", "enhanced": "enhanced_{}"})
    names = [f"{side}_{score}" for score in ("si_sdr", "gap") for side in ("noisy", "enhanced")]
    return rounded(scores.select("utt_id", F.size("clean").cast("bigint").alias("n"), "n_rows", *names), *names)


SEGMENT = 20
CHUNKS = f"""sizes AS (SELECT DISTINCT utt_id, n FROM samples), starts AS (SELECT utt_id, unnest(CASE WHEN n <= {SEGMENT} THEN [0] WHEN n % {SEGMENT} = 0 THEN list_transform(range(n // {SEGMENT}), lambda k: k * {SEGMENT})
 ELSE list_append(list_transform(range(n // {SEGMENT}), lambda k: k * {SEGMENT}), n - {SEGMENT}) END) AS chunk_start FROM sizes),
cells AS (SELECT utt_id, chunk_start, i - chunk_start AS t, x FROM starts JOIN samples USING (utt_id) WHERE i >= chunk_start AND i < chunk_start + {SEGMENT})"""


@query(f"""WITH {RIR_SAMPLES}, {CHUNKS}, members AS (SELECT rir_id, row_number() OVER (ORDER BY rir_id) - 1 AS k, count(*) OVER () AS c FROM (SELECT DISTINCT rir_id FROM rirs)),
drawn AS (SELECT utt_id, chunk_start, rir_id FROM starts JOIN members ON (utt_id * 7 + chunk_start) % c = k),
wet AS (SELECT utt_id, chunk_start, rir_id, t + h.i AS t, sum(c.x * h.x) AS y FROM drawn JOIN cells c USING (utt_id, chunk_start) JOIN aligned h USING (rir_id) WHERE t + h.i < {SEGMENT} GROUP BY utt_id, chunk_start, rir_id, t + h.i),
gains AS (SELECT utt_id, chunk_start, rir_id, sqrt({SEGMENT} / sum(y * y)) AS g, sum(y) AS wet, sum(y * y) AS energy FROM wet GROUP BY 1, 2, 3)
SELECT utt_id, CAST(chunk_start AS INT) AS chunk_start, rir_id, {r('any_value(g) * sum(x)')} AS clean, {r('any_value(g * wet)')} AS degraded, {r('any_value(g * g * energy)')} AS energy FROM gains JOIN cells USING (utt_id, chunk_start) GROUP BY 1, 2, 3""")
def training_pair_sums(spark, d):
    """Chunks of all signals, each with a drawn response, both sides scaled by the degraded one."""
    pairs = jobs.training_pairs(views.signals(spark, d), views.rirs(spark, d), SEGMENT, 0, draw=F.col("utt_id") * 7 + F.col("chunk_start"))
    out = pairs.select("utt_id", F.col("chunk_start").cast("int").alias("chunk_start"), "rir_id", exprs.total("clean").alias("clean"), exprs.total("degraded").alias("degraded"), exprs.energy("degraded").alias("energy"))
    return rounded(out, "clean", "degraded", "energy")


@query(f"""WITH {SAMPLES}, noisy AS (SELECT utt_id, i, n, x, x + (i % 5) * 3 AS y FROM samples), gains AS (SELECT utt_id, any_value(n) AS n, sqrt(any_value(n) / sum(y * y)) AS g FROM noisy GROUP BY 1),
crops AS (SELECT utt_id, g, CASE WHEN n <= {SEGMENT} THEN 0 ELSE utt_id * 13 % (n - {SEGMENT} + 1) END AS s FROM gains)
SELECT utt_id, CAST(any_value(s) AS INT) AS crop_start, {r('any_value(g) * sum(x)')} AS clean, {r('any_value(g) * sum(y)')} AS noisy FROM noisy JOIN crops USING (utt_id) WHERE i >= s AND i < s + {SEGMENT} GROUP BY 1""")
def noise_training_sums(spark, d):
    """Paired signals, scaled by the noisy one, cropped at the same drawn place."""
    clean = views.signals(spark, d)
    noisy = clean.withColumn("samples", F.transform("samples", lambda x, i: x + (i % 5) * 3))
    out = jobs.noise_training_pairs(clean, noisy, SEGMENT, 0, draw=F.col("utt_id") * 13)
    return rounded(out.select("utt_id", "crop_start", exprs.total("clean").alias("clean"), exprs.total("noisy").alias("noisy")), "clean", "noisy")
