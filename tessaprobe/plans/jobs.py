"""The study's composite jobs: each takes tables and returns tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaprobe.functions import exprs, stats
from tessaprobe.functions.constants import BLOCK_ORDER, BLOCKS, representative_layers
from tessaprobe.operators import evaluation, manifold, represent, sampling, signal
from tessaprobe.sources import tables
from tessaprobe.sources.shared import written


PROFILE_ROWS = 250_000


def utterance_profile(facts: DataFrame) -> DataFrame:
    """Per utterance: similarity at the first and last layer by name (there at the lowest and the highest level, of several rows the least and the
    largest), the least of all, and how many layers it has.

    An utterance's rows come together once; what is compared are numbers, so all aggregates are by hash. Layers are a small dimension. A task
    gets about PROFILE_ROWS rows however many there are, and so its hash tables keep their size.
    """
    tasks = max(facts.sparkSession.sparkContext.defaultParallelism, -(-facts.count() // PROFILE_ROWS))
    rank = F.row_number().over(Window.orderBy("layer"))  # a row per layer of the models
    layers = facts.select("layer").distinct().withColumn("_rank", rank)
    rows = facts.join(layers, "layer").select("clean_idx", "_rank", F.col("snr").cast("double").alias("_snr"), F.col("CKA").cast("double").alias("CKA")).repartition(tasks, "clean_idx")
    cells = rows.groupBy("clean_idx", "_rank", "_snr").agg(F.min("CKA").alias("low"), F.max("CKA").alias("high"))
    each = cells.groupBy("clean_idx", "_rank").agg(F.min_by("low", "_snr").alias("first"), F.max_by("high", "_snr").alias("last"), F.min("low").alias("low"))
    return each.groupBy("clean_idx").agg(
        F.min_by("first", "_rank").alias("first_cka"), F.max_by("last", "_rank").alias("last_cka"), F.min("low").alias("least_cka"), F.count("*").alias("n_layers")
    )


def sensitivity(facts: DataFrame, level: str, keys: Sequence[str] = ("layer",)) -> DataFrame:
    """The line of the mean similarity over the level, per layer: slope, intercept, r2."""
    means = facts.where(F.col(level).isNotNull()).groupBy(*keys, level).agg(F.avg("CKA").alias("CKA"))
    return stats.fit_line(means, keys, "CKA", level)


def layer_sensitivity(facts: DataFrame) -> DataFrame:
    fits = sensitivity(facts.where(exprs.is_norm1("layer")), "snr")
    return fits.withColumn("block_rank", exprs.layer_rank("layer", BLOCKS))


def level_heat(facts: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Layer by level table of means."""
    cells = facts.groupBy("layer").pivot("snr", list(levels)).agg(F.avg("CKA"))
    return cells.select("layer", *[F.col(f"`{x}`").alias(f"snr_{int(x)}") for x in levels])


def cross_model(facts: DataFrame) -> DataFrame:
    return sensitivity(facts, "snr", ("model_name", "layer"))


def trend_statistics(fits: DataFrame) -> DataFrame:
    """Per model: how slopes and intercepts of its layers go together. Fits are few rows of many facts: written once, used twice."""
    fits = written(fits, "fits")
    keys = ["model_name"]
    rho = stats.spearman(fits, keys, "slope", "intercept")
    main = fits.groupBy(*keys).agg(
        F.count("*").alias("n_layers"), stats.pearson("slope", "intercept").alias("r"), F.regr_slope("slope", "intercept").alias("fit_slope"),
        F.regr_intercept("slope", "intercept").alias("fit_intercept"), *[F.avg(c).alias(f"mean_{c}") for c in ("slope", "intercept", "r2")],
        *[F.median(c).alias(f"median_{c}") for c in ("slope", "intercept", "r2")],
    )
    return main.where("n_layers >= 2").join(rho, keys)


def trend_points(fits: DataFrame) -> DataFrame:
    """100 points of each model's line of slope over intercept."""
    lines = fits.groupBy("model_name").agg(
        F.regr_slope("slope", "intercept").alias("slope"), F.regr_intercept("slope", "intercept").alias("intercept"), F.min("intercept").alias("low"), F.max("intercept").alias("high")
    )
    return stats.line_points(lines, ["model_name"], "low", "high")


def gain_correlation(facts: DataFrame) -> DataFrame:
    """Per layer: correlation of similarity and quality gain, both centred within (layer, level)."""
    rows = facts.where(exprs.is_norm1("layer") & F.col("snr").isNotNull()).withColumn("gain", F.col("enhanced_pesq") - F.col("noisy_pesq"))
    both = stats.centered(rows, ["layer", "snr"], "CKA", "gain")
    return both.groupBy("layer").agg(stats.pearson("CKA_c", "gain_c").alias("r"), F.count("*").alias("n"))


def diffusion_monotonicity(psi: DataFrame, keys: Sequence[str] = ("layer",)) -> DataFrame:
    """Per layer: line and rank correlation of the distance from the reference level."""
    dist = manifold.distance_from_reference(psi, keys).dropna(subset=["dist"])
    means = dist.groupBy(*keys, "snr").agg(F.avg("dist").alias("dist"))
    return stats.fit_line(means, keys, "dist", "snr").join(stats.spearman(means, keys, "dist", "snr"), list(keys))


def block_rows(df: DataFrame) -> DataFrame:
    """The rows of the layers that stand for a block, with the block's label and order."""
    return df.join(representative_layers(df.sparkSession), "layer")


def block_monotonicity(psi: DataFrame) -> DataFrame:
    """label, block_order, slope, intercept, r2, n_levels, rho of each block's representative layer."""
    return diffusion_monotonicity(block_rows(psi), ("label", "block_order"))


def distance_slices(psi: DataFrame) -> DataFrame:
    """Layer distances at the slice levels, scaled per level, with the architectural rank of both layers."""
    levels = sampling.slice_levels(psi, "snr")
    dist = manifold.layer_distances(psi.join(levels, "snr", "left_semi"))
    return stats.min_max(dist, ["snr"], "dist", "scaled").withColumns(
        {"rank_i": exprs.layer_rank(F.col("layer_i").cast("string"), BLOCK_ORDER), "rank_j": exprs.layer_rank(F.col("layer_j").cast("string"), BLOCK_ORDER)}
    )


def reverb_sensitivity(facts: DataFrame) -> DataFrame:
    kept = facts.where(exprs.is_norm1("layer") & F.col("target_c50").between(-5, 25))
    return sensitivity(kept, "target_c50")


def demo_subset_snr(facts: DataFrame, noise: str | None, units: int, order: Column) -> DataFrame:
    """One noise, and of every (level, noise) cell a sample of utterances with all their rows."""
    kept = facts.where(F.col("noise_name") == noise) if noise else facts
    return sampling.per_cell_sample(kept, ["snr", "noise_name"], "clean_idx", units, order)


def demo_subset_reverb(facts: DataFrame, units: int, order: Column) -> DataFrame:
    """A few levels, one response (if responses are named), and of every level a sample of utterances."""
    kept = facts.join(sampling.strided_levels(facts, "target_c50"), "target_c50", "left_semi")
    if "rir_name" in facts.columns:
        first = kept.agg(F.min("rir_name").alias("_first"))
        kept = kept.join(first, F.col("rir_name") == F.col("_first"), "left_semi")
    return sampling.per_cell_sample(kept, ["target_c50"], "clean_idx", units, order)


def build_subset(spark: SparkSession, source: str, out: str, *, noise: str = "TBUS", units: int = 20, budget_mb: float = 50, seed: int = 42) -> dict[str, int]:
    """Write the demo tables and return their sizes; the sum is held to the budget.

    The reverb table has two names in use; either is read.
    """
    inputs = {f"cka_snr_{m}": f"{source}/cka_snr_{m}.parquet" for m in ("muse", "mpsenet", "demucs")}
    tables.require_tables(spark, **inputs)
    order, sizes = sampling.hash_order(seed, "snr", "noise_name", "clean_idx"), {}
    for name, path in inputs.items():
        sizes[name] = tables.write_table(demo_subset_snr(tables.read_table(spark, path), noise, units, order), f"{out}/{name}.parquet")
    reverb = tables.resolve_table(spark, f"{source}/cka_reverb_muse_epoch_48.parquet", f"{source}/cka_reverb_muse.parquet")
    rows = demo_subset_reverb(tables.read_table(spark, reverb), units, sampling.hash_order(seed, "target_c50", "clean_idx"))
    sizes["cka_reverb"] = tables.write_table(rows, f"{out}/cka_reverb_muse.parquet")
    if sum(sizes.values()) > budget_mb * 1e6:
        raise tables.OverBudget(f"the subset has {sum(sizes.values())} bytes, the budget is {budget_mb} MB")
    return sizes


def rir_metadata(rirs: DataFrame, rate: int) -> DataFrame:
    """wav_path, family, samples -> filename and acoustics, rounded as they are written."""
    rows = signal.rir_acoustics(rirs, rate).withColumn("filename", exprs.rir_filename("wav_path", "family"))
    return rows.select("filename", "wav_path", "family", *[F.round(c, n).alias(c) for c, n in (("rt60", 4), ("drr", 2), ("c50", 2), ("c80", 2))])


def rir_split(meta: DataFrame, share: float, order: Column) -> DataFrame:
    """By the official split where any is given, else stratified by RT60."""
    if "split" in meta.columns and not meta.where(F.trim(F.coalesce("split", F.lit(""))) != "").isEmpty():
        return meta.select("filename", exprs.official_split("split").alias("split"))
    return sampling.stratified_split(meta, "filename", "rt60", share, order)


def split_counts(meta: DataFrame, split: DataFrame) -> DataFrame:
    family = F.when(F.coalesce("family", F.lit("")) == "", "unknown").otherwise(F.col("family"))
    return meta.join(split, "filename").groupBy(family.alias("family")).pivot("split", ["train", "test"]).count().fillna(0, ["train", "test"])


def test_responses(split: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The metadata of the responses whose split is test, and the names among these that the metadata lacks."""
    wanted = split.where("split = 'test'").select("filename")
    return meta.drop("split").join(wanted, "filename", "left_semi"), wanted.join(meta, "filename", "left_anti")


def reverb_manifest(utterances: DataFrame, responses: DataFrame, k: int, draw: Column, order: Column) -> DataFrame:
    """The reverb test manifest: every utterance with k responses (rows of the RIR metadata), and the file it would be."""
    rirs = responses.select(F.col("filename").alias("rir_id"), F.col("wav_path").alias("rir_filename"), "rt60", "drr", "c50")
    drawn = sampling.assign_k(utterances, "utterance_id", rirs, "rir_id", k, draw, order)
    return drawn.join(rirs, "rir_id").select(
        "utterance_id", "rir_id", "rir_filename", "rt60", "drr", "c50", F.concat_ws("_", F.col("utterance_id").cast("string"), F.concat("rir_id", F.lit(".wav"))).alias("filepath")
    )


def noise_manifest(utterances: DataFrame) -> DataFrame:
    return utterances.select("utterance_id", F.concat(F.col("utterance_id").cast("string"), F.lit(".wav")).alias("filepath"))


def reverb_test_set(manifest: DataFrame, utterances: DataFrame, rirs: DataFrame) -> DataFrame:
    """The manifest's rows with ``reverberant``; ``utterances`` (utterance_id, samples), ``rirs`` (rir_id, samples)."""
    return signal.reverberate(manifest.join(utterances, "utterance_id"), rirs, "rir_id", target=None)


def imported(dataset: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that the index names, and the ids that the data set lacks."""
    return dataset.join(ids, "id", "left_semi"), ids.join(dataset, "id", "left_anti")


def training_pairs(waves: DataFrame, rirs: DataFrame, segment: int, seed: int, epoch: int = 0, draw: Column | None = None) -> DataFrame:
    """Reverb training: each chunk with a drawn response (by a hash, or by the whole number ``draw``), both sides scaled by the degraded side's energy."""
    chunks = signal.chunked(waves, "samples", segment).select("utt_id", "chunk_start", F.col("chunk").alias("clean"))
    drawn = sampling.assign_one(chunks, ["utt_id", "chunk_start"], rirs, "rir_id", seed + epoch, draw)
    pairs = signal.reverberate(drawn, rirs, "rir_id", "clean", target=None)
    gain = exprs.rms_gain("reverberant")
    return pairs.withColumn("_g", gain).select(
        "utt_id", "chunk_start", "rir_id", F.transform("clean", lambda x: x * F.col("_g")).alias("clean"), F.transform("reverberant", lambda x: x * F.col("_g")).alias("degraded")
    )


def noise_training_pairs(clean: DataFrame, noisy: DataFrame, segment: int, seed: int, draw: Column | None = None) -> DataFrame:
    """Noise training: paired files of equal length, scaled by the noisy side, one crop at the same place of both."""
    both = clean.select("utt_id", F.col("samples").alias("clean")).join(noisy.select("utt_id", F.col("samples").alias("noisy")), "utt_id")
    checked = both.withColumn("_ok", F.assert_true(F.size("clean") == F.size("noisy"), F.lit("clean and noisy differ in length"))).where("_ok is null").drop("_ok")
    place = exprs.crop_start(F.size("clean"), segment, seed, "utt_id") if draw is None else F.pmod(draw, F.greatest(F.lit(1), F.size("clean") - segment + 1))
    start = checked.withColumns({"_g": exprs.rms_gain("noisy"), "crop_start": place.cast("int")})
    return start.select(
        "utt_id", "crop_start", *[F.transform(exprs.chunk(c, F.col("crop_start"), segment), lambda x: x * F.col("_g")).alias(c) for c in ("clean", "noisy")]
    )


def training_spectra(pairs: DataFrame, keys: Sequence[str], sides: Sequence[str] = ("clean", "degraded"), n_fft: int = 510, hop: int = 100, win: int = 510, power: float = 0.3) -> DataFrame:
    """keys, side, frame_idx, mag, pha, re, im: the compressed spectra that training reads, of both sides of each pair."""
    side = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("samples")) for s in sides])).alias("_s")
    rows = pairs.select(*keys, side).select(*keys, "_s.side", "_s.samples")
    return signal.stft(rows, [*keys, "side"], n_fft=n_fft, hop=hop, win=win, power=power)


def evaluated(manifest: DataFrame, degraded: DataFrame, enhanced: DataFrame, clean: DataFrame, domain: str, scorers: dict[str, Callable] | None = None) -> DataFrame:
    """The test manifest's waves by file (``degraded``, ``enhanced``: filepath, samples) and by utterance (``clean``: utterance_id,
    samples), cut to the shortest of the three, input and enhanced scored against clean: the result table of one domain."""
    rows = manifest.join(degraded.select("filepath", F.col("samples").alias("degraded")), "filepath")
    rows = rows.join(enhanced.select("filepath", F.col("samples").alias("enhanced")), "filepath")
    rows = rows.join(clean.select("utterance_id", F.col("samples").alias("clean")), "utterance_id")
    rows = signal.score_sides(rows, scorers or {}, "clean", {"degraded": "{}_input", "enhanced": "{}"})
    return evaluation.result_table(rows.withColumn("domain", F.lit(domain)))


def evaluation_report(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    return evaluation.summary(scores), evaluation.by_rt60(scores.where("domain = 'reverb'"))


def cka_of_degraded(
    clean: DataFrame, degraded: DataFrame, conditions: Sequence[str], extract: Callable, activation_schema: str, keys: Sequence[str] = ("model", "layer"), pool: Callable = represent.pool_first
) -> DataFrame:
    """utt_id, conditions, keys, CKA: activations of clean (utt_id, samples) and degraded waves (utt_id, conditions, samples) by the
    user's producer, pooled, and compared.

    ``extract`` gets pandas batches (utt_id, conditions, samples; conditions are null for clean) and yields token rows
    (utt_id, conditions, keys, call_idx, time_idx, token_idx, vec); ``pool`` takes such rows and their keys.
    """
    kinds = {f.name: f.dataType for f in degraded.schema}
    bare = clean.select("utt_id", *[F.lit(None).cast(kinds[c]).alias(c) for c in conditions], F.col("samples").cast("array<double>").alias("samples"))
    both = degraded.select("utt_id", *conditions, F.col("samples").cast("array<double>").alias("samples")).unionByName(bare)
    pooled = pool(represent.extract_with(both, extract, activation_schema), ["utt_id", *conditions, *keys])
    return represent.cka_of_conditions(pooled, ["utt_id", *keys], conditions).select("utt_id", *conditions, *keys, "CKA")


def cka_table(waves: DataFrame, noises: DataFrame, levels: Iterable[float], extract: Callable, activation_schema: str, keys: Sequence[str] = ("model", "layer"), pool: Callable = represent.pool_first) -> DataFrame:
    """Similarity of every utterance under every noise (noise_name) at every level (level), see ``cka_of_degraded``."""
    spark = waves.sparkSession
    grid = sampling.degradation_grid(waves.select("utt_id"), noises.select("noise_name"), spark.createDataFrame([(float(x),) for x in levels], "level double"))
    pairs = grid.join(waves.select("utt_id", "samples"), "utt_id").join(noises.select("noise_name", F.col("samples").alias("noise")), "noise_name")
    noisy = pairs.select("utt_id", "noise_name", "level", exprs.mix_at_snr("samples", F.col("noise"), F.col("level")).alias("samples"))
    return cka_of_degraded(waves, noisy, ["noise_name", "level"], extract, activation_schema, keys, pool)


def cka_reverb_table(waves: DataFrame, rirs: DataFrame, targets: Iterable[float], extract: Callable, activation_schema: str, keys: Sequence[str] = ("model", "layer"), pool: Callable = represent.pool_first, early: int = exprs.EARLY_SAMPLES) -> DataFrame:
    """The reverb half of the grid: every utterance through every response (rir_name, samples) at every target C50 (target_c50)."""
    spark = waves.sparkSession
    grid = sampling.degradation_grid(waves.select("utt_id"), rirs.select("rir_name"), spark.createDataFrame([(float(x),) for x in targets], "target_c50 double"))
    wet = signal.reverberate(grid.join(waves.select("utt_id", "samples"), "utt_id"), rirs, "rir_name", early=early).select("utt_id", "rir_name", "target_c50", F.col("reverberant").alias("samples"))
    return cka_of_degraded(waves, wet, ["rir_name", "target_c50"], extract, activation_schema, keys, pool)


def quality_report(psi: DataFrame) -> DataFrame:
    """Per layer: components, order of eigenvalues, rank correlation of the first coordinate with the level, spread over noises."""
    first = psi.withColumn("dc1", F.element_at("psi", 1))
    ordered = F.forall(F.sequence(F.lit(1), F.size("eigenvalues") - 1), lambda i: F.get("eigenvalues", i) - F.get("eigenvalues", i - 1) <= 1e-5)
    base = first.withColumn("_o", F.when(F.size("eigenvalues") > 1, ordered).otherwise(True)).groupBy("layer").agg(
        F.min("n_components").alias("least_components"), F.max("n_components").alias("most_components"), F.min("_o").alias("eigenvalues_descend")
    )
    return base.join(stats.spearman(first, ["layer"], "dc1", "snr"), "layer").join(evaluation.noise_structure(first, ["layer"], "noise_name", "dc1"), "layer")


def ranked_layers(facts: DataFrame) -> DataFrame:
    """Distinct layers in architectural order."""
    return facts.select("layer").distinct().withColumn("rank", exprs.layer_rank("layer", BLOCKS)).withColumn("place", F.row_number().over(Window.orderBy("rank", "layer")))
