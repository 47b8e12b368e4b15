"""Helpers that several operators share."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# A word is a run of anything but the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """The text with A-Z, and nothing else, in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows as one struct column ``row`` beside the given working columns, so
    that no column of the input can clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, **columns: Column) -> DataFrame:
    """The inverse of ``packed``: the input's columns and the given ones; an input
    column with the name of an added one (in any case) gives way."""
    taken = {n.lower() for n in columns}
    names = [f.name for f in df.schema["row"].dataType.fields if f.name.lower() not in taken]
    return df.select(*[F.col("row").getField(n).alias(n) for n in names],
                     *[c.alias(n) for n, c in columns.items()])


def numbered(df: DataFrame, group: Sequence[str], chunk: Column, order: Sequence[Column], out: str,
             chunks: bool = True) -> DataFrame:
    """Add ``out``: a gapless number from 0 within the group. No task sorts a whole
    group: rows are numbered inside (group, chunk) and shifted by the rows of the
    chunks before. ``chunk`` must not depend on the order of rows; ``chunks`` False
    says that it is the same everywhere, which spares the counting."""
    keys = [*group, "_chunk"]
    df = df.withColumn("_chunk", chunk)
    if chunks:
        # Rows that come dealt out by the group alone would stay so.
        df = df.repartition(*keys)
    inside = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(out, F.row_number().over(inside).cast("bigint") - 1)
    if not chunks:
        return ranked.drop("_chunk")
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = df.groupBy(*keys).agg(F.count("*").alias("_n")).select(
        *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return ranked.join(shift, keys).withColumn(out, F.col(out) + F.col("_shift")).drop("_chunk", "_shift")
