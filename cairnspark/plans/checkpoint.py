"""Cutting a plan's lineage between rounds."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that all executors share; one of our own where it is unset and Spark is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="cairnspark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_table(spark: SparkSession) -> str:
    """A folder in the shared one that isn't there yet."""
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


def cut(df: DataFrame, at: str | None = None) -> DataFrame:
    """df written into the shared folder (or to at) and read back, so that lost executors cost no earlier rounds."""
    at = at or new_table(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
