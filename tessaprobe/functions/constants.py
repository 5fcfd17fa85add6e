"""Dimension tables and constants of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the domain.
SAMPLE_RATE = 16000
EARLY_SAMPLES = 800
DEFAULT_SNRS = tuple(range(-20, 41, 5))
TARGET_C50S = tuple(-5 + 2.5 * i for i in range(13))
REFERENCE_C50 = 50.0
BLOCK_LABELS = ("Enc-L1", "Enc-L2", "Latent", "Dec-L2", "Dec-L1", "Refinement")
REPRESENTATIVE_LAYER = "TCFTransformer.{block}.mhca_blks.0.transformer_layers.0.norm1"
BLOCK_ORDER = ("encoder_level1", "encoder_level2", "decoder_level2", "decoder_level1")
BLOCKS = ("encoder_level1", "encoder_level2", "latent", "decoder_level2", "decoder_level1", "mag_refinement")
TEST_ROOMS = ("office", "meeting", "lecture", "bathroom", "kitchen", "corridor")
RT60_BINS = ((0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, float("inf")))
REPORT_BINS = ((0.0, 0.3), (0.3, 0.5), (0.5, 0.8), (0.8, 1.5))


def representative_layers(spark: SparkSession) -> DataFrame:
    """layer, label, block_order: the layer that stands for each block."""
    rows = [(REPRESENTATIVE_LAYER.format(block=b), label, i) for i, (b, label) in enumerate(zip(BLOCKS, BLOCK_LABELS, strict=True))]
    return spark.createDataFrame(rows, "layer string, label string, block_order int")


def layers_dim(spark: SparkSession, layers: DataFrame) -> DataFrame:
    """One row per distinct ``layer``: block, block_order, layer_type, is_norm1."""
    from tessaprobe.functions import exprs

    return layers.select("layer").distinct().select(
        "layer", exprs.block_of("layer").alias("block"), exprs.layer_rank("layer", BLOCKS).alias("block_order"),
        exprs.layer_type("layer").alias("layer_type"), exprs.is_norm1("layer").alias("is_norm1"),
    )


def conditions_dim(spark: SparkSession, kind: str) -> DataFrame:
    """Levels of one kind of degradation; the reference level is marked, never a sentinel number."""
    levels = [(float(x), False) for x in (DEFAULT_SNRS if kind == "snr" else TARGET_C50S)]
    levels.append((None, True) if kind == "snr" else (REFERENCE_C50, True))
    return spark.createDataFrame([(kind, *x) for x in levels], "kind string, level double, is_reference boolean")
