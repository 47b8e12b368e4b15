"""Ordered work inside a key (row numbers, previous row, running totals) that
stays spread out when one key holds a large share of the table.

A window partitioned by the key alone puts the whole key into one task. Here a
key is cut into chunks by a whole-number position that is unique within the key:
``chunk = (position - min) div width``. A chunk then holds at most ``width`` rows
and a key has at most ``range / width`` chunks, whatever the data looks like. The
first windows run per (key, chunk); one summary row per chunk is scanned per key
to obtain what each chunk inherits, and is joined back on (key, chunk). If the
whole position range fits into one chunk, none of that is needed and the plan is
the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK_ROWS = 100_000
MAX_CHUNKS = 1_000_000


@dataclass(frozen=True)
class Chunking:
    """How positions map to chunks; ``single`` if one chunk covers them all."""

    base: int
    width: int
    single: bool


def chunking(df: DataFrame, position: str, chunk_rows: int = CHUNK_ROWS) -> Chunking:
    """Choose the chunk width from the smallest and largest position (one small
    aggregate; Parquet answers it from row-group statistics or one column)."""
    low, high = df.agg(F.min(position), F.max(position)).first()
    if low is None:
        return Chunking(0, chunk_rows, True)
    span = int(high) - int(low) + 1
    return Chunking(int(low), max(chunk_rows, -(-span // MAX_CHUNKS)), span <= chunk_rows)


def number_rows(df: DataFrame, key: str, position: str, out: str,
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``out``: the 0-based rank of the row's position within its key."""
    return running(df, key, position, sums={out: F.lit(1)}, chunk_rows=chunk_rows,
                   exclusive=True)


def running(df: DataFrame, key: str, position: str, sums: Mapping[str, Column],
            chunk_rows: int = CHUNK_ROWS, exclusive: bool = False) -> DataFrame:
    """Add running totals (one per entry of ``sums``) in position order within the
    key, with or without the row itself."""
    cut = chunking(df, position, chunk_rows)
    end = -1 if exclusive else Window.currentRow
    if cut.single:
        w = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()})
    df = df.withColumn("_chunk", _chunk(position, cut))
    w = (Window.partitionBy(key, "_chunk").orderBy(position)
         .rowsBetween(Window.unboundedPreceding, end))
    local = df.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()})
    before = (Window.partitionBy(key).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    totals = df.groupBy(key, "_chunk").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    carry = totals.select(key, "_chunk", *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums])
    return _inherit(local, carry, key).withColumns(
        {n: F.col(n) + F.col(f"_c_{n}") for n in sums}
    ).drop("_chunk", *[f"_c_{n}" for n in sums])


def previous(df: DataFrame, key: str, position: str, columns: Sequence[str],
             prefix: str = "prev_", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the values that ``columns`` have in the row before, within the key."""
    cut = chunking(df, position, chunk_rows)
    row = F.struct(*columns)
    if cut.single:
        w = Window.partitionBy(key).orderBy(position)
        df = df.withColumn("_prev", F.lag(row).over(w))
    else:
        df = df.withColumn("_chunk", _chunk(position, cut))
        last = df.groupBy(key, "_chunk").agg(F.max_by(row, position).alias("_last"))
        carry = last.select(key, "_chunk", F.lag("_last").over(
            Window.partitionBy(key).orderBy("_chunk")).alias("_carry"))
        w = Window.partitionBy(key, "_chunk").orderBy(position)
        df = df.withColumn("_prev", F.lag(row).over(w))
        df = _inherit(df, carry, key).withColumn("_prev", F.coalesce("_prev", "_carry"))
        df = df.drop("_chunk", "_carry")
    return df.withColumns({f"{prefix}{c}": F.col(f"_prev.{c}") for c in columns}).drop("_prev")


def _chunk(position: str, cut: Chunking) -> Column:
    return F.floor((F.col(position) - F.lit(cut.base)) / F.lit(cut.width)).cast("bigint")


def _inherit(rows: DataFrame, carry: DataFrame, key: str) -> DataFrame:
    match = rows[key].eqNullSafe(carry[key]) & (rows["_chunk"] == carry["_chunk"])
    return rows.join(carry, match).drop(carry[key]).drop(carry["_chunk"])
