"""Bounded query results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from anomalens.config import MAX_RESULT_ROWS


def limited(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def _text(field: T.StructField) -> F.Column:
    c = F.col(f"`{field.name}`")
    nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
    return F.to_json(c) if nested else c.cast("string")


def capped(df: DataFrame, max_rows: int = MAX_RESULT_ROWS) -> DataFrame:
    """One row ``(columns, rows, row_count, truncated)`` with at most ``max_rows``
    rows as text. One row more than the cap is fetched to learn whether rows were
    left out; the limit stops the scan early."""
    names = F.array(*[F.lit(c) for c in df.columns]).cast("array<string>")
    cells = F.array(*[_text(f) for f in df.schema.fields]).cast("array<string>")
    fetched = df.limit(max_rows + 1).agg(F.collect_list(cells).alias("_rows"))
    return fetched.select(
        names.alias("columns"),
        F.slice("_rows", 1, max_rows).alias("rows"),
        F.least(F.size("_rows"), F.lit(max_rows)).cast("bigint").alias("row_count"),
        (F.size("_rows") > max_rows).alias("truncated"),
    )
