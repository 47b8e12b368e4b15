"""Parallelism of work that is heavy per row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame, waves: int = 1) -> DataFrame:
    """Rows of a file scan over all cores if the files yield fewer splits than
    there are cores (one small file is one split, however much work its rows are).
    A scan that already has enough splits is left as it is: no shuffle. With ``waves``
    each core gets so many tasks, for narrow rows that are hours of work: a task is then
    short, and a few splits more than cores do not take twice the time."""
    tasks = scan.sparkSession.sparkContext.defaultParallelism * waves
    return scan.repartition(tasks) if scan.rdd.getNumPartitions() < tasks else scan
