"""Readers and writers of the study's tables. NaN becomes null here, once."""

from __future__ import annotations

import io
import json
import os
import re
import warnings
import wave
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaprobe.functions import exprs
from tessaprobe.functions.constants import SAMPLE_RATE, TEST_ROOMS
from tessaprobe.operators.represent import decode_f32
from tessaprobe.sources.shared import written


class MissingTable(FileNotFoundError):
    """None of the paths of a table exists."""


class OverBudget(RuntimeError):
    """A written table is larger than allowed."""


SCHEMAS = {
    "cka_snr": "clean_idx bigint, snr double, noise_name string, layer string, CKA double, model_name string, noisy_pesq double, enhanced_pesq double",
    "cka_reverb": "clean_idx bigint, target_c50 double, rir_name string, layer string, CKA double",
    "centroids": "noise_name string, snr double, layer string, centroid binary, n_samples int",
    "rir_metadata": "filename string, wav_path string, family string, rt60 double, drr double, c50 double, c80 double",
    "rir_split": "filename string, split string",
    "reverb_test_manifest": "utterance_id string, rir_id string, rir_filename string, rt60 double, drr double, c50 double, filepath string",
    "noise_test_manifest": "utterance_id string, filepath string",
}


@dataclass(frozen=True)
class ProbeConf:
    """Paths of the corpora; unset ones come from the session (``probe.path.<name>``), then from the environment."""

    speech: str | None = None
    noise: str | None = None
    rir: str | None = None

    def filled(self, spark: SparkSession) -> ProbeConf:
        last = env_paths()
        return replace(self, **{k: getattr(self, k) or spark.conf.get(f"probe.path.{k}", None) or getattr(last, k) for k in ("speech", "noise", "rir")})


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return bool(fs.exists(p))


def resolve_table(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, the full table before the demo one; an error that names them all otherwise."""
    for path in paths:
        if exists(spark, path):
            return path
    raise MissingTable("none of these tables exists: " + ", ".join(paths))


def require_tables(spark: SparkSession, **paths: str) -> None:
    missing = [f"{name} ({path})" for name, path in paths.items() if not exists(spark, path)]
    if missing:
        raise MissingTable("missing inputs: " + ", ".join(missing))


def cleaned_numbers(df: DataFrame) -> DataFrame:
    kinds = (T.DoubleType, T.FloatType)
    return df.withColumns({f.name: exprs.clean_number(f.name) for f in df.schema if isinstance(f.dataType, kinds)})


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: str | None = None) -> DataFrame:
    """A probe table; only the wanted columns are read."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return cleaned_numbers(df.select(*columns) if columns else df)


def union_models(spark: SparkSession, paths: dict[str, str], columns: Sequence[str]) -> DataFrame:
    """Tables of several models in one, the model's name set, each with the layers that are probed for it."""
    out = None
    for model, path in sorted(paths.items()):
        part = read_table(spark, path, columns).withColumn("model_name", F.lit(model)).where(exprs.probe_layer("model_name", "layer"))
        out = part if out is None else out.unionByName(part)
    return out


def read_psi(spark: SparkSession, path: str) -> DataFrame:
    """A wide psi table as one vector per row."""
    df = spark.read.parquet(path)
    wide = [c for c in df.columns if c.startswith("psi_")]
    return df.withColumn("psi", exprs.fold_columns(df.columns)).drop(*wide) if wide else df


def read_centroids(spark: SparkSession, pattern: str) -> DataFrame:
    """Many small centroid files in one scan, their bytes decoded."""
    return spark.read.schema(SCHEMAS["centroids"]).parquet(pattern).withColumn("centroid", decode_f32("centroid"))


def samples_of(content: bytes) -> tuple[int, list[list[float]]]:
    """Rate and channels of a PCM WAV file."""
    with wave.open(io.BytesIO(content)) as f:
        width, n = f.getsampwidth(), f.getnchannels()
        raw = f.readframes(f.getnframes())
        if width == 3:
            parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8) / float(1 << 23)
        else:
            x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
            x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
        return f.getframerate(), x.reshape(-1, n).T.tolist()


WAVES = "path string, utt_id string, folder_name string, sr int, channels array<array<float>>, samples array<float>, n_samples int"


def read_waves(spark: SparkSession, folder: str | Sequence[str], rate: int | None = None, pattern: str = "*.wav") -> DataFrame:
    """path, utt_id, folder_name, sr, channels, samples (first channel), n_samples of every WAV below a folder, or several. Files whose names don't
    fit ``pattern`` are dropped as they are listed and never opened; the others are dealt to tasks by size."""
    from tessaprobe.operators.signal import resampled

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder if isinstance(folder, str) else list(folder)).select("path", "content")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                sr, channels = samples_of(bytes(content))
                if rate and sr != rate:
                    common = int(np.gcd(sr, rate))
                    channels, sr = [resampled(np.array(c), rate // common, sr // common).tolist() for c in channels], rate
                parts = path.split("/")
                rows.append((path, parts[-1].rsplit(".", 1)[0], parts[-2], sr, channels, channels[0], len(channels[0])))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in WAVES.split(", ")])

    return files.mapInPandas(decode, WAVES)


def read_folders(spark: SparkSession, folder: str, names: Sequence[str], what: str, rate: int) -> DataFrame:
    """``read_waves`` of the named folders only, no other is looked into; one that is missing is left out with a warning."""
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in names}
    found = [path for name, path in paths.items() if exists(spark, path)]
    for name in names:
        if paths[name] not in found:
            warnings.warn(f"no folder of {what} {name} in {folder}", stacklevel=3)
    return read_waves(spark, found, rate) if found else spark.createDataFrame([], WAVES)


def clean_speech(spark: SparkSession, folder: str, speakers: Sequence[str], rate: int = SAMPLE_RATE) -> DataFrame:
    """Utterances of the wanted speakers, one folder each; a speaker without a folder is left out with a warning."""
    return read_folders(spark, folder, speakers, "speaker", rate).where(F.col("folder_name").isin(*speakers)).withColumnRenamed("folder_name", "speaker")


def noise_table(spark: SparkSession, folder: str, rate: int = SAMPLE_RATE, names: Sequence[str] | None = None) -> DataFrame:
    """Noises by the name of their folder (all, or those in ``names``), decoded once into a table."""
    waves = read_waves(spark, folder, rate) if names is None else read_folders(spark, folder, names, "noise", rate)
    return written(waves.select(F.col("folder_name").alias("noise_name"), "sr", "samples", "n_samples"), "noises")


def any_of(parts: Sequence[str]) -> str:
    """A glob of WAV names that contain one of the parts."""
    return "*{" + ",".join(re.sub(r"([\\*?\[\]{},])", r"\\\1", part) for part in parts) + "}*.wav"


def rir_table(spark: SparkSession, folder: str, rate: int = SAMPLE_RATE, rooms: Sequence[str] | None = None, channel: int = 0) -> DataFrame:
    """Responses cut to start at their peak; with ``rooms`` only files whose names contain one of them are opened."""
    rirs = read_waves(spark, folder, rate, any_of(rooms) if rooms else "*.wav")
    rirs = rirs.select(F.col("utt_id").alias("rir_name"), "path", "sr", exprs.channel("channels", channel).alias("samples"))
    return rirs.withColumn("samples", exprs.onset_aligned("samples"))


def rirs_of_test_rooms(spark: SparkSession, folder: str, rate: int = SAMPLE_RATE) -> DataFrame:
    """Responses of the rooms that are held out for tests."""
    return rir_table(spark, folder, rate, TEST_ROOMS)


def rir_files(spark: SparkSession, folder: str) -> DataFrame:
    """wav_path (relative), family guess; what lies under manifests or checksums is no response."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(folder).select("path")
    root = folder.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + root.replace(".", "[.]") + "/", "")
    out = files.select(rel.alias("wav_path"))
    return out.where(~F.regexp_extract("wav_path", "^[^/]+", 0).isin("manifests", "checksums")).withColumn("family_guess", exprs.family_guess("wav_path"))


def manifest_families(spark: SparkSession, pattern: str) -> DataFrame:
    """wav_path -> family of manifest CSVs; of rows for one path the last (by file, then line) counts, blank paths don't."""
    rows = spark.read.option("header", True).csv(pattern).select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    rows = rows.withColumn("wav_path", F.trim("wav_path")).where(F.coalesce("wav_path", F.lit("")) != "")
    w = Window.partitionBy("wav_path").orderBy(F.desc("_file"), F.desc("_line"))
    family = F.trim(F.coalesce("family", F.lit("")))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("wav_path", family.alias("family"))


def with_family(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """The manifest's family, also a blank one, before the guess."""
    return files.join(manifest, "wav_path", "left").withColumn("family", F.coalesce("family", "family_guess"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """ids of ``id|path`` lines; blank lines are dropped."""
    ids = spark.read.text(path).select(F.trim(F.element_at(F.split("value", "[|]"), 1)).alias("id"))
    return ids.where("id <> ''")


def read_split_map(spark: SparkSession, path: str) -> DataFrame:
    """filename, split of one JSON object {filename: split}."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("filename", "split"))


def write_split_map(spark: SparkSession, split: DataFrame, path: str) -> None:
    """As one JSON object: a file of this kind lists the responses of a study, which are few; larger splits stay tables."""
    rows = {r["filename"]: r["split"] for r in split.orderBy("filename").toLocalIterator()}
    spark.createDataFrame([(json.dumps(rows),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return cleaned_numbers(spark.read.option("header", True).schema(schema).csv(path))


def write_metadata(df: DataFrame, path: str, digits: dict[str, int] | None = None) -> None:
    """CSV with a header; numbers are formatted only here."""
    for name, n in (digits or {}).items():
        df = df.withColumn(name, exprs.fixed_text(name, n))
    df.write.mode("overwrite").option("header", True).csv(path)


def import_utterances(spark: SparkSession, pattern: str) -> DataFrame:
    """Staged dataset rows (id, clean.array, noisy.array, sampling rate) flattened."""
    df = spark.read.parquet(pattern)
    return df.select("id", F.col("clean.array").alias("clean"), F.col("noisy.array").alias("noisy"), F.col("clean.sampling_rate").alias("sr"))


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Degraded waveforms, keyed by columns instead of file names."""
    pairs.write.mode("overwrite").partitionBy("kind").parquet(path)


def write_table(df: DataFrame, path: str, budget_bytes: int | None = None) -> int:
    """Write and return the size; over the budget it is an error."""
    df.write.mode("overwrite").parquet(path)
    p, fs = _path(df.sparkSession, path)
    size = int(fs.getContentSummary(p).getLength())
    if budget_bytes is not None and size > budget_bytes:
        raise OverBudget(f"{path} has {size} bytes, the budget is {budget_bytes}")
    return size


def env_paths() -> ProbeConf:
    return ProbeConf(*(os.environ.get(f"PROBE_{k}_PATH") for k in ("SPEECH", "NOISE", "RIR")))
