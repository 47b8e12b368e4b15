"""Joins and rankings that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

HOT_SHARE = 10_000
SALTS = 512
RANK_BUCKETS = 200
GROUP_ROWS = 1_000_000


def join_unique(rows: DataFrame, table: DataFrame, key: str, weight: str,
                how: str = "inner") -> DataFrame:
    """Join many rows to a table with one row per key, where a few keys may own
    most rows. ``weight`` is a column of ``table``: how many rows the key owns.

    Keys that own more than 1/10000 of all rows number fewer than 10000, so
    their part of the table is broadcast (a proven bound). The other keys
    take an ordinary join; hot rows pass it under salted keys that match nothing.
    ``table`` is read three times, so hand in written data.
    """
    total = table.agg(F.sum(weight).alias("n")).scalar()
    values = [c for c in table.columns if c not in (key, weight)]
    packed = table.select(key, weight, F.struct(*values).alias("_v"))
    hot = packed.filter(F.col(weight) * HOT_SHARE > total).select(
        F.col(key).alias("_hk"), F.col("_v").alias("_hv"))
    cold = packed.filter(F.col(weight) * HOT_SHARE <= total).select(
        F.col(key).alias("_ck"), F.lit(0).alias("_salt"), F.col("_v").alias("_cv"))
    # NULL is a key like any other; the values say whether a hot key was met.
    out = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hk")), "left")
    salt = F.when(F.col("_hv").isNull(), F.lit(0)).otherwise(
        1 + F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).cast("int")
    out = out.withColumn("_s", salt).join(
        cold, F.col(key).eqNullSafe(F.col("_ck")) & (F.col("_s") == F.col("_salt")), "left")
    out = out.withColumn("_m", F.coalesce("_hv", "_cv"))
    if how == "inner":
        out = out.filter(F.col("_m").isNotNull())
    return out.select(*rows.columns, *[F.col(f"_m.{c}").alias(c) for c in values])


def rank_within(df: DataFrame, group: str, value: str, tie: str, out: str,
                group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``out``: 1-based rank by ``value`` (largest first, then ``tie``) within
    ``group``. ``df`` should be written data: its largest group is counted first.
    Up to ``group_rows`` rows a plain window does; beyond that see
    ``_rank_spread``."""
    largest = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    if largest > group_rows:
        return _rank_spread(df, group, value, tie, out)
    w = Window.partitionBy(group).orderBy(F.desc(value), F.asc(tie))
    return df.withColumn(out, F.row_number().over(w).cast("bigint"))


def _rank_spread(df: DataFrame, group: str, value: str, tie: str, out: str) -> DataFrame:
    """The same rank without bringing a group into one task.

    Approximate quantiles (a mergeable sketch) cut every group into buckets of
    similar size; rows are ranked inside their bucket and shifted by the number
    of rows in the buckets above. The cut points only balance the work, the rank
    is exact. Both helper tables have at most ``RANK_BUCKETS`` rows per group and
    are left to the engine's size-checked broadcast.
    """
    steps = F.array(*[F.lit(i / RANK_BUCKETS) for i in range(1, RANK_BUCKETS)])
    cuts = df.groupBy(group).agg(F.percentile_approx(value, steps, F.lit(10_000)).alias("_cuts"))
    cuts = cuts.select(F.col(group).alias("_cg"), F.array_distinct("_cuts").alias("_cuts"))
    v = F.col(value)
    placed = df.join(cuts, F.col(group).eqNullSafe(F.col("_cg"))).withColumn(
        "_b", F.size(F.filter("_cuts", lambda x: x > v)))
    above = Window.partitionBy("_og").orderBy("_ob").rowsBetween(Window.unboundedPreceding, -1)
    shift = (placed.groupBy(F.col(group).alias("_og"), F.col("_b").alias("_ob"))
             .agg(F.count("*").alias("_n"))
             .withColumn("_shift", F.coalesce(F.sum("_n").over(above), F.lit(0))))
    inside = Window.partitionBy(group, "_b").orderBy(v.desc(), F.col(tie))
    ranked = placed.withColumn("_r", F.row_number().over(inside)).join(
        shift, F.col(group).eqNullSafe(F.col("_og")) & (F.col("_b") == F.col("_ob")))
    return ranked.select(*df.columns, (F.col("_r") + F.col("_shift")).alias(out))
