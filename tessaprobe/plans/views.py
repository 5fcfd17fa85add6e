"""The study's tables as views over the driver's tables: as DataFrames, and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaprobe.operators.represent import vector_mean


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def probe_facts(spark: SparkSession, d: str) -> DataFrame:
    block = F.lit("mag_refinement")
    for k, name in ((4, "decoder_level1"), (3, "decoder_level2"), (2, "latent"), (1, "encoder_level2"), (0, "encoder_level1")):
        block = F.when(F.col("l_suppkey") % 6 == k, name).otherwise(block)
    layer = F.concat(F.lit("TCFTransformer."), block, F.lit(".mhca_blks.0.transformer_layers."), (F.col("l_partkey") % 4).cast("string"), F.lit(".norm1"))
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("model_name"), F.col("l_linestatus").alias("noise_name"), F.col("l_orderkey").alias("clean_idx"),
        F.col("l_linenumber").cast("double").alias("snr"), layer.alias("layer"), (F.col("l_discount") * 5 + F.col("l_quantity") / 100).alias("CKA"),
        (1 + F.col("l_tax") * 10).alias("noisy_pesq"), (1 + F.col("l_tax") * 10 + F.col("l_quantity") / 50).alias("enhanced_pesq"),
    )


def reverb_facts(spark: SparkSession, d: str) -> DataFrame:
    return probe_facts(spark, d).select(
        "model_name", "noise_name", "layer", "clean_idx", "CKA", (F.lit(-5.0) + F.lit(2.5) * (F.col("clean_idx") % 13)).cast("double").alias("target_c50"),
        F.concat(F.lit("rir_"), (F.col("clean_idx") % 10).cast("string")).alias("rir_name"),
    )


def rir_metadata(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("rir_idx"), F.concat(F.lit("rir_"), F.col("p_partkey").cast("string")).alias("filename"), F.col("p_brand").alias("family"),
        (F.col("p_size").cast("double") / 40 - 0.05).alias("rt60"), (F.col("p_retailprice") / 100).alias("c50"), F.col("p_type").alias("split"),
    )


def eval_scores(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("domain"), F.col("o_orderkey").alias("utterance_id"), (F.col("o_custkey") % 200).cast("double").alias("r")
        , price.alias("p"), F.col("o_custkey").alias("c"),
    ).select(
        "domain", "utterance_id", (F.col("r") / 100).alias("rt60"), F.when(F.col("c") % 17 == 0, -1.0).otherwise(1 + F.col("p") / 150000).alias("pesq"),
        F.when(F.col("c") % 19 == 0, -1.0).otherwise(1 + F.col("p") / 200000).alias("pesq_input"), (F.col("p") / 25000).alias("si_sdr"), (F.col("p") / 30000).alias("si_sdr_input"),
    )


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """layer, token_idx, vec, vec_id: all vectors, numbered within their label."""
    df = table(spark, d, "embeddings").withColumn("token_idx", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    return df.select(F.col("label").alias("layer"), "token_idx", F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "vec_id")


def all_vectors(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "embeddings")
    return df.select(F.col("label").alias("layer"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def psi_table(spark: SparkSession, d: str) -> DataFrame:
    """layer, snr, noise_name, psi: centroids of (label, vec_id mod 5)."""
    df = all_vectors(spark, d).withColumn("snr", (F.col("vec_id") % 5).cast("double"))
    return vector_mean(df, ["layer", "snr"], "vec", "n_samples").select("layer", "snr", F.lit("all").alias("noise_name"), F.col("vec").alias("psi"), "n_samples")


def signals(spark: SparkSession, d: str) -> DataFrame:
    """utt_id, samples: each user's values in order of time."""
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("utt_id")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("r"))
    return rows.select("utt_id", F.transform("r", lambda x: x["value"]).alias("samples"))


def noises(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).select(F.col("utt_id").alias("noise_id"), F.col("samples").alias("noise"))


def rirs(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).select(F.col("utt_id").alias("rir_id"), F.transform("samples", lambda x, i: x / (1 + i)).alias("samples"))


PROBE = """probe_facts AS (SELECT l_returnflag AS model_name, l_linestatus AS noise_name, l_orderkey AS clean_idx, CAST(l_linenumber AS DOUBLE) AS snr,
  concat('TCFTransformer.', CASE l_suppkey % 6 WHEN 0 THEN 'encoder_level1' WHEN 1 THEN 'encoder_level2' WHEN 2 THEN 'latent' WHEN 3 THEN 'decoder_level2'
    WHEN 4 THEN 'decoder_level1' ELSE 'mag_refinement' END, '.mhca_blks.0.transformer_layers.', CAST(l_partkey % 4 AS VARCHAR), '.norm1') AS layer,
  l_discount * 5 + l_quantity / 100 AS CKA, 1 + l_tax * 10 AS noisy_pesq, 1 + l_tax * 10 + l_quantity / 50 AS enhanced_pesq FROM lineitem)"""
REVERB = PROBE + """, reverb_facts AS (SELECT model_name, noise_name, layer, clean_idx, CKA, CAST(-5 + 2.5 * (clean_idx % 13) AS DOUBLE) AS target_c50,
  concat('rir_', CAST(clean_idx % 10 AS VARCHAR)) AS rir_name FROM probe_facts)"""
RIRS = """rir_metadata AS (SELECT p_partkey AS rir_idx, concat('rir_', CAST(p_partkey AS VARCHAR)) AS filename, p_brand AS family,
  CAST(p_size AS DOUBLE) / 40 - 0.05 AS rt60, p_retailprice / 100 AS c50, p_type AS split FROM part)"""
EVALS = """eval_scores AS (SELECT o_orderstatus AS domain, o_orderkey AS utterance_id, CAST(o_custkey % 200 AS DOUBLE) / 100 AS rt60,
  CASE WHEN o_custkey % 17 = 0 THEN -1.0 ELSE 1 + o_totalprice / 150000 END AS pesq, CASE WHEN o_custkey % 19 = 0 THEN -1.0 ELSE 1 + o_totalprice / 200000 END AS pesq_input,
  o_totalprice / 25000 AS si_sdr, o_totalprice / 30000 AS si_sdr_input FROM orders)"""
TOKENS = """ranked AS (SELECT label AS layer, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS token_idx FROM embeddings),
tokens AS (SELECT layer, token_idx, vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS v FROM ranked)"""
PSI = """entries AS (SELECT label AS layer, CAST(vec_id % 5 AS DOUBLE) AS snr, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
psi AS (SELECT layer, snr, i, avg(v) AS x FROM entries GROUP BY ALL)"""
SAMPLES = """samples AS (SELECT user_id AS utt_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""
RIR_SAMPLES = SAMPLES + """, rirs AS (SELECT utt_id AS rir_id, i, n, x / (1 + i) AS x FROM samples),
peaks AS (SELECT rir_id, min(i) AS p FROM (SELECT rir_id, i, abs(x) AS a, max(abs(x)) OVER (PARTITION BY rir_id) AS m FROM rirs) WHERE a = m GROUP BY rir_id),
aligned AS (SELECT rir_id, i - p AS i, n - p AS n, x FROM rirs JOIN peaks USING (rir_id) WHERE i >= p)"""
