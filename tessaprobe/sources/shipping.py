"""Sends this package to the executors, so that functions running there can import it from any working directory."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: a zip of the package goes out with the application's files."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    package = Path(__file__).resolve().parents[1]
    stage = Path(tempfile.mkdtemp(prefix="package-"))
    shutil.copytree(package, stage / "zip" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(stage / package.name), "zip", stage / "zip"))
    _sent.add(context.applicationId)
