"""Column functions over loosely typed values."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from anomalens.config import NUMERIC_ATOL, NUMERIC_RTOL
from anomalens.functions.sqltext import strip

_DIGITS = r"\d+(?:_\d+)*"
_FLOAT_TEXT = rf"(?i)^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?$"
_WORD_NUMBER = r"(?i)^[+-]?(?:inf|infinity|nan)$"


def to_number(c: Column) -> Column:
    """Text to double, NULL where it is no number. The accepted spellings are
    digits with optional ``_`` groups, fraction and exponent, and inf / nan; JSON
    booleans count as 1 and 0."""
    t = strip(c.cast("string"))
    return (
        F.when(t.rlike(_FLOAT_TEXT), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
        .when(t.rlike(_WORD_NUMBER), t.try_cast("double"))
        .when(t == "true", F.lit(1.0))
        .when(t == "false", F.lit(0.0))
    )


def close_numbers(a: Column, b: Column, rtol: float = NUMERIC_RTOL,
                  atol: float = NUMERIC_ATOL) -> Column:
    """Closeness of two double columns; NULL and NaN are close to nothing."""
    span = F.greatest(F.lit(atol), F.lit(rtol) * F.greatest(F.abs(a), F.abs(b)))
    close = (a == b) | (F.abs(a - b) <= span)
    return F.coalesce(close & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def numeric_close(a: Column, b: Column, rtol: float = NUMERIC_RTOL,
                  atol: float = NUMERIC_ATOL) -> Column:
    return close_numbers(to_number(a), to_number(b), rtol, atol)


def _strict_json(text: str) -> str | None:
    """Strict JSON for JSON with repeated keys (the last one counts) or NaN and
    infinities (a VARIANT holds them as text); None if it is no JSON at all."""
    try:
        return json.dumps(json.loads(text, parse_constant=str), ensure_ascii=False, allow_nan=False)
    except (ValueError, RecursionError):
        return None


def _literal_json(text: str | None) -> str | None:
    if text is None:
        return None
    found = _strict_json(text)
    if found is not None:
        return found
    try:
        return json.dumps(ast.literal_eval(text), ensure_ascii=False, default=list)
    except Exception:
        return None


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _literals_to_json(values: pd.Series) -> pd.Series:
    """Python-style literals and lenient JSON to JSON text; NULL stays NULL, so does a failure."""
    return pd.Series([None if rows is None else
                      [None if r is None else [_literal_json(v) for v in r] for r in rows]
                      for rows in values])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _to_strict_json(values: pd.Series) -> pd.Series:
    """Lenient JSON texts to strict ones; NULL stays NULL, so does a failure."""
    return pd.Series([None if row is None else [None if v is None else _strict_json(v) for v in row]
                      for row in values])


# Marked so that no later filter is pushed below it and makes it run twice.
literals_to_json = _literals_to_json.asNondeterministic()
to_strict_json = _to_strict_json.asNondeterministic()


def needs_literal(c: Column) -> Column:
    """The text if it opens a list or map but is not JSON, else NULL."""
    t = strip(c)
    return F.when(t.rlike(r"^[\[{]") & F.try_parse_json(t).isNull(), t)


def coerce_with(raw: Column, literal: Column) -> Column:
    """Text to VARIANT: boolean, null, list or map (JSON, else the JSON rendering
    of a literal given in ``literal``), integer, float, else the text itself."""
    t = strip(raw)
    low = F.lower(t)
    whole = t.rlike(r"(?U)^-?\d+\z")
    real = t.rlike(r"(?U)^-?\d*\.\d+(?:[eE][-+]?\d+)?\z") | t.rlike(r"(?U)^-?\d+[eE][-+]?\d+\z")
    text = t.cast("variant")
    return (
        F.when(low.isin("true", "false"), (low == "true").cast("variant"))
        .when(low.isin("null", "none"), F.parse_json(F.lit("null")))
        .when(t.rlike(r"^[\[{]"),
              F.coalesce(F.try_parse_json(t), F.try_parse_json(literal), text))
        .when(whole, F.coalesce(t.try_cast("bigint").cast("variant"),
                                t.try_cast("decimal(38,0)").cast("variant"), text))
        .when(real, F.coalesce(t.try_cast("double").cast("variant"), text))
        .otherwise(text)
    )


def coerce_value(raw: Column) -> Column:
    """Text to a typed VARIANT (see ``coerce_with``)."""
    literal = literals_to_json(F.array(F.array(needs_literal(raw))))
    return coerce_with(raw, literal[0][0])
