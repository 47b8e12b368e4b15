"""Shared storage for data that must outlive an executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``."""
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError(f"set {_SETTING} to a folder that the driver and all executors share")
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a Parquet table in shared storage and go on from there.

    A lost executor then costs its own tasks only, and, unlike a checkpointed RDD,
    the table keeps its size statistics (so small sides are still broadcast) and
    is read column by column.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
