"""Tool calls out of model-output texts.

A turn never fails: what cannot be read becomes a flagged call or a warning.
Everything is a per-row expression over the whole text; the only Python is the
reading of Python-style list and map literals and of JSON with repeated keys or NaN,
and only those values are handed to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from anomalens.config import KNOWN_TOOLS
from anomalens.functions.sqltext import collapse_spaces, literal, strip
from anomalens.functions.values import coerce_with, literals_to_json, needs_literal, to_number, to_strict_json

# Marks and tags of the call formats.
_MARKS = r"<\|(?:im_start|im_end|endoftext|eot_id|end_of_turn)\|>"
_THINK = r"(?isU)<think\b[^>]*>(.*?)</think\s*>"
_THINK_OPEN = r"(?isU)<think\b[^>]*>.*\z"
_BLOCK = r"(?isU)<tool_call\b[^>]*>(.*?)</tool_call\s*>"
_FUNCTION = r"(?sU)<function\s*=\s*([^\s>]+)\s*>(.*?)</function\s*>"
_PARAMETER = r"(?sU)<parameter\s*=\s*([^\s>]+)\s*>(.*?)</parameter\s*>"
_FUNCTION_OPEN = r"(?sU)<function\s*=\s*([^\s>]+)\s*>(.*)\z"
_ANY_TAG = r"(?U)</?(?:tool_call|function|parameter)\b[^>]*>"
_BRACES = r"(?s)\{.*\}"


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def clean_marks(text: Column) -> Column:
    """Text without special tokens, stripped."""
    return strip(F.regexp_replace(text, _MARKS, ""))


def thinking_of(text: Column) -> Column:
    """Text of the first closed thinking block; NULL if there is none."""
    return F.when(text.rlike(_THINK), strip(F.regexp_extract(text, _THINK, 1)))


def without_thinking(text: Column) -> Column:
    """Text without closed thinking blocks and without an unclosed tail."""
    closed = F.regexp_replace(text, _THINK, " ")
    return strip(F.regexp_replace(closed, _THINK_OPEN, " "))


def call_blocks(body: Column) -> Column:
    """Contents of all call blocks, in order, stripped."""
    return F.transform(F.regexp_extract_all(body, F.lit(_BLOCK), F.lit(1)), strip)


def plain_text(body: Column) -> Column:
    """What is left of the text outside the calls."""
    for pattern in (_BLOCK, _FUNCTION, _PARAMETER, _ANY_TAG):
        body = F.regexp_replace(body, pattern, " ")
    return collapse_spaces(body)


def _parameters(text: Column) -> Column:
    """Parameter name to raw text; the last of several equal names wins."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit(_PARAMETER), F.lit(0)),
        lambda p: F.struct(F.regexp_extract(p, _PARAMETER, 1).alias("key"),
                           F.regexp_extract(p, _PARAMETER, 2).alias("value")))
    return F.map_from_entries(F.aggregate(
        found, F.array().cast("array<struct<key:string,value:string>>"),
        lambda kept, p: F.concat(F.filter(kept, lambda k: k["key"] != p["key"]), F.array(p))))


def _call(name: Column, params: Column, args: Column, malformed: Column, raw: Column) -> Column:
    return F.struct(
        name.alias("name"), params.alias("params"), args.alias("json"),
        malformed.alias("malformed"),
        F.when(malformed, F.lit("invalid JSON")).alias("parse_error"), raw.alias("raw"))


def _xml_calls(block: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(block, F.lit(_FUNCTION), F.lit(0)),
        lambda f: _call(F.regexp_extract(f, _FUNCTION, 1),
                        _parameters(F.regexp_extract(f, _FUNCTION, 2)),
                        _null("variant"), F.lit(False), block))


def _member(obj: Column, names: Sequence[str]) -> Column:
    """First of several members of a variant object that is neither missing nor
    an empty value (null, false, 0, empty text, list or map)."""
    found = []
    for n in names:
        v = F.try_variant_get(obj, f"$.{n}", "variant")
        found.append(F.when(~F.to_json(v).isin("null", "false", "0", "0.0", '""', "[]", "{}"), v))
    return F.coalesce(*found)


def _json_call(blob: Column, strict: Column) -> Column:
    """``strict``: the same JSON without repeated keys and NaN, where it has any."""
    obj = F.coalesce(F.try_parse_json(blob), F.try_parse_json(strict))
    name = F.coalesce(_member(obj, ("name", "tool", "function")).cast("string"), F.lit(""))
    args = _member(obj, ("arguments", "parameters", "args"))
    # Arguments may be JSON inside a text.
    args = F.when(F.to_json(args).startswith('"'), F.try_parse_json(args.cast("string"))).otherwise(args)
    args = F.when(F.to_json(args).startswith("{"), args).otherwise(F.parse_json(F.lit("{}")))
    return F.when(obj.isNull(), _call(F.lit(""), _null("map<string,string>"), F.parse_json(F.lit("{}")), F.lit(True), blob)
                  ).otherwise(_call(name, _null("map<string,string>"), args, F.lit(False), blob))


def _blob(block: Column) -> Column:
    """JSON text of a block: the block itself or the span between its outer braces."""
    return F.when(block.startswith("{"), block).otherwise(F.regexp_extract(block, _BRACES, 0))


def _calls_of(block: Column, strict: Column) -> Column:
    blob = _blob(block)
    return (F.when(block.rlike(_FUNCTION), _xml_calls(block))
            .when(blob != "", F.array(_json_call(blob, strict))))


def _lenient_blob(block: Column) -> Column:
    """The JSON text of a block that is not strict JSON, else NULL."""
    blob = _blob(block)
    return F.when(~block.rlike(_FUNCTION) & (blob != "") & F.try_parse_json(blob).isNull(), blob)


def _block_warning(block: Column) -> Column:
    return (F.when(block == "", F.lit("empty_block"))
            .when(~block.rlike(_FUNCTION) & (_blob(block) == ""),
                  F.concat(F.lit("unparsable_block: "), block)))


def _mention(plain: Column, known: Sequence[str]) -> Column:
    return F.coalesce(_null("string"), *[
        F.when(plain.rlike(rf"(?U)\b{literal(t)}\b"), F.lit(f"tool_without_call: {t}")) for t in known])


def extract_calls(df: DataFrame, text: str = "text",
                  known_tools: Sequence[str] = KNOWN_TOOLS) -> DataFrame:
    """Add ``thinking``, ``calls`` (``array<struct<name, arguments VARIANT,
    malformed, parse_error, raw>>``), ``plain`` and ``warnings``.

    Calls are XML-style functions inside call blocks, else JSON objects with the
    usual aliases. If none is found, an unclosed function tag still counts, with
    a warning.
    """
    body, found = F.col("_body"), F.col("_found")
    staged = (
        df.withColumn("_clean", clean_marks(F.col(text)))
        .withColumn("thinking", thinking_of(F.col("_clean")))
        .withColumn("_body", without_thinking(F.col("_clean")))
        .withColumn("_blocks", call_blocks(body))
        .withColumn("_strict", to_strict_json(F.when(
            F.exists("_blocks", lambda b: _lenient_blob(b).isNotNull()), F.transform("_blocks", _lenient_blob))))
        # Zipped outside the lambda: a Python result cannot be read inside one.
        .withColumn("_found", F.flatten(F.filter(F.transform(
            F.arrays_zip(F.col("_blocks").alias("b"), F.coalesce(
                "_strict", F.array().cast("array<string>")).alias("s")),
            lambda z: F.when(z["b"] != "", _calls_of(z["b"], z["s"]))), lambda c: c.isNotNull())))
        .withColumn("plain", plain_text(body))
        .withColumn("_loose", (F.size(found) == 0) & body.rlike(_FUNCTION_OPEN))
        .withColumn("_found", F.when(F.col("_loose"), F.array(_call(
            F.regexp_extract(body, _FUNCTION_OPEN, 1),
            _parameters(F.regexp_extract(body, _FUNCTION_OPEN, 2)),
            _null("variant"), F.lit(False), body))).otherwise(found))
        .withColumn("_values", F.transform(found, lambda c: F.map_values(c["params"])))
        .withColumn("_literals", literals_to_json(F.when(
            F.exists(F.flatten(F.filter("_values", lambda v: v.isNotNull())),
                     lambda v: needs_literal(v).isNotNull()),
            F.transform("_values", lambda vs: F.transform(vs, needs_literal)))))
    )
    literals = F.coalesce("_literals", F.array().cast("array<array<string>>"))
    calls = F.transform(
        F.arrays_zip(found.alias("c"), F.col("_values").alias("v"), literals.alias("l")),
        lambda z: F.struct(
            z["c"]["name"].alias("name"),
            F.coalesce(z["c"]["json"], F.to_variant_object(F.map_from_arrays(
                F.map_keys(z["c"]["params"]),
                F.transform(z["v"], lambda v, j: coerce_with(v, F.get(z["l"], j)))))).alias("arguments"),
            z["c"]["malformed"].alias("malformed"), z["c"]["parse_error"].alias("parse_error"),
            z["c"]["raw"].alias("raw")))
    warnings = F.when(F.col(text).isNull(), F.array(F.lit("null_output"))).otherwise(
        F.array_compact(F.concat(
            F.transform("_blocks", _block_warning),
            F.array(F.when(F.col("_loose"), F.lit("unclosed_call")),
                    F.when(F.size(found) == 0, _mention(F.col("plain"), known_tools))))))
    empty = F.array().cast("array<struct<name:string,arguments:variant,malformed:boolean,"
                           "parse_error:string,raw:string>>")
    return staged.select(
        *df.columns, "thinking", F.coalesce(calls, empty).alias("calls"),
        F.coalesce("plain", F.lit("")).alias("plain"), warnings.alias("warnings"))


def first_call(df: DataFrame) -> DataFrame:
    """Add ``call`` (only the first call of a turn is carried out) and
    ``extra_calls`` (how many others were dropped)."""
    return df.withColumns({
        "call": F.get("calls", F.lit(0)),
        "extra_calls": F.greatest(F.size("calls") - 1, F.lit(0)),
    })


def call_outcome(call: Column, known_tools: Sequence[str] = KNOWN_TOOLS) -> Column:
    """``no_call``, ``malformed_call``, ``unknown_tool`` or ``dispatched``."""
    return (
        F.when(call.isNull(), F.lit("no_call"))
        .when(call["malformed"], F.lit("malformed_call"))
        .when(~call["name"].isin(*known_tools), F.lit("unknown_tool"))
        .otherwise(F.lit("dispatched"))
    )


_REQUIRED = ("diagnosis", "root_cause_dimension", "key_findings")


def check_answer(args: Column) -> Column:
    """``struct(status, missing, bad_index)`` of a final answer's arguments.

    ``missing_fields`` if a required field is absent or empty, ``bad_finding``
    with the index of the first finding that is no object with claim and value,
    ``bad_arguments`` / ``tool_internal_error`` where a field has a type that
    cannot be used, else ``ok``.
    """
    missing = F.array_compact(F.array(*[
        F.when(_member(args, (n,)).isNull(), F.lit(n)) for n in _REQUIRED]))
    findings = F.try_variant_get(args, "$.key_findings", "variant")
    shape = F.to_json(findings)
    items = F.try_variant_get(args, "$.key_findings", "array<variant>")
    good = F.transform(items, lambda f: F.to_json(f).startswith("{")
                       & F.try_variant_get(f, "$.claim", "variant").isNotNull()
                       & F.try_variant_get(f, "$.value", "variant").isNotNull())
    first_bad = F.when(shape.rlike(r'^["{]'), F.lit(0)).otherwise(
        (F.array_position(good, F.lit(False)) - 1).cast("int"))
    confidence = F.to_json(F.try_variant_get(args, "$.confidence", "variant"))
    status = (
        F.when(F.size(missing) > 0, F.lit("missing_fields"))
        .when(~shape.rlike(r'^[\["{]'), F.lit("bad_arguments"))
        .when(first_bad >= 0, F.lit("bad_finding"))
        .when(confidence.rlike(r"^[\[{]"), F.lit("bad_arguments"))
        .when(confidence.startswith('"') & to_number(
            F.try_variant_get(args, "$.confidence", "string")).isNull(), F.lit("tool_internal_error"))
        .otherwise(F.lit("ok"))
    )
    return F.struct(
        status.alias("status"),
        F.when(status == "missing_fields", missing).alias("missing"),
        F.when(status == "bad_finding", first_bad).alias("bad_index"))
