"""Parquet tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from anomalens.plans.spread import spread

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings "
         "pages benchmark labels conversations").split()


def heavy(spark: SparkSession, folder: str, name: str, waves: int = 1) -> DataFrame:
    """A table whose rows take much work each."""
    return spread(table(spark, folder, name), waves)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
