"""What plans with Python workers need of a session."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started."""
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark
