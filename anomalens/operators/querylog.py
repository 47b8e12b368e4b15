"""Audit of a log of SQL texts. All columns are computed row by row in built-in
expressions: one scan, no shuffle, until something is counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from anomalens.config import (
    ALLOWED_STATEMENTS, EXECUTION, FORBIDDEN_FUNCTIONS, FORBIDDEN_KEYWORDS, ILLEGAL, TIMEOUT,
)
from anomalens.functions import sqltext as S


def audit(df: DataFrame, sql: str = "sql", strict: bool = False,
          allowed: Sequence[str] = ALLOWED_STATEMENTS,
          words: Sequence[str] = FORBIDDEN_KEYWORDS,
          names: Sequence[str] = FORBIDDEN_FUNCTIONS) -> DataFrame:
    """Add ``verdict`` (``empty``, ``multi_statement``, ``kind_not_allowed``,
    ``banned_keyword``, ``banned_function`` or ``ok``) and ``hit``, the count, kind,
    word or function that decided it.

    ``strict`` removes string literals before comments; the default order lets a
    ``--`` inside a literal hide the rest of its line.
    """
    # A column of its own: the cleaned text feeds some thirty expressions.
    body = df.withColumn("_body", S.strip_noise(F.col(sql), strict))
    judged = body.withColumn("_v", S.verdict_of(F.col(sql), F.col("_body"), allowed, words, names))
    return judged.select(*df.columns, "_v.verdict", "_v.hit")


def normalized(df: DataFrame, sql: str = "sql") -> DataFrame:
    """Add ``form`` (normal form) and ``masked_form`` (numbers as ``?``)."""
    out = df.withColumn("form", S.normalize(F.col(sql)))
    return out.withColumn("masked_form", S.mask_numbers(F.col("form")))


def outcome_tally(df: DataFrame, ok: str = "ok", error_type: str = "error_type",
                  by: Sequence[str] = ()) -> DataFrame:
    """Calls in total and by outcome, over the whole log or per group."""
    kind = F.col(error_type)
    return df.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(ok)).alias("ok"),
        F.count_if(kind == ILLEGAL).alias("illegal"),
        F.count_if(kind == TIMEOUT).alias("timeout"),
        F.count_if(kind == EXECUTION).alias("execution_error"),
    )
