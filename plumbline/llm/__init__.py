"""Operators of a training-data pipeline: one module per operator, their queries in `queries`."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def reachable(spark: SparkSession) -> None:
    """Lets the workers of this session import this package from where the driver has it.

    That is enough where all machines see the same folder; elsewhere ship the package with `--py-files`.
    """
    root, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{paths}".rstrip(":")
