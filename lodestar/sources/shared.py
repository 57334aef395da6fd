"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one if all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestar-checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's part of the shared folder, which is deleted when the driver's JVM ends."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lodestar-{context.applicationId}")
    store = root.getFileSystem(context._jsc.hadoopConfiguration())
    store.mkdirs(root)
    store.deleteOnExit(root)
    return f"{root.toString()}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and return a DataFrame that reads it.

    The result has no lineage to recompute: a lost executor costs no more than its running tasks,
    and several readers of the result share one evaluation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
