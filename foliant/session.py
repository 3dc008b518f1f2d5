"""Session helpers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def reach_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library from where the driver did, if it isn't
    installed. On a cluster ship it with --py-files; a path that is absent is harmless."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark
