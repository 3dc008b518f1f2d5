"""Tables that cut lineage, in the folder that all machines share."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_root() -> str:
    root = os.path.join(tempfile.gettempdir(), "checkpoints", str(os.getpid()))
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``. Where that
    setting is absent and Spark runs on one machine (tests) it is a local one, removed as
    Python ends; on a cluster its absence is an error, as executors share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def removed_at_exit(spark: SparkSession, path: str) -> None:
    """Has the driver's JVM remove the folder ``path``, which is there, as it ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts lineage. The
    table is removed as the driver ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    out = df.write.mode("overwrite")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    removed_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
