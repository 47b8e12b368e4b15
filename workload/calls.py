"""Call extraction over ``conversations``: every turn's whole text is wrapped in
one of eight call formats, by the same expression in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from anomalens.operators import calls as C
from workload.tables import heavy

_Q = "chr(39)"
_RAW = f"""
CASE (conv_id + turn) % 8
 WHEN 0 THEN '<|im_start|>' || text || ' <think>plan ' || conv_id || '</think><tool_call><function=execute_sql>'
   || '<parameter=sql>first</parameter><parameter=sql> SELECT ' || turn || ' </parameter><parameter=purpose>'
   || role || '</parameter></function></tool_call><|im_end|>'
 WHEN 1 THEN text || '<tool_call>' || CASE WHEN conv_id % 2 = 0
   THEN '{{"name": "old", "name": "retrieve_context", "arguments": {{"query": "' || role || '", "top_k": ' || turn || '}}}}'
   ELSE 'json {{"tool": "", "function": "retrieve_context", "args": "{{\\"query\\": \\"' || role || '\\", \\"top_k\\": ' || turn || '}}"}}'
   END || '</tool_call>'
 WHEN 2 THEN '<THINK a=1>deep</THINK> <tool_call> </tool_call><tool_call>' || role || '</tool_call>' || text
 WHEN 3 THEN text || ' I should call execute_sql now <think>cut off ' || conv_id
 WHEN 4 THEN '<tool_call><function=final_answer><parameter=diagnosis>' || text
   || '</parameter><parameter=root_cause_dimension>' || role || '</parameter><parameter=key_findings>'
   || CASE conv_id % 3 WHEN 0 THEN '[{{' || {_Q} || 'claim' || {_Q} || ': ' || {_Q} || 'c' || {_Q} || ', "value": ' || turn || '}}]'
      WHEN 1 THEN '[]' ELSE '[{{"claim": "c", "value": 1}}, {{"claim": "d"}}]' END
   || '</parameter></function></tool_call>'
 WHEN 5 THEN '<tool_call><function=execute_sql><parameter=sql>SELECT ' || conv_id || '</parameter>'
 WHEN 6 THEN '<tool_call>{{"name": broken ' || conv_id || '}}</tool_call><tool_call><function=' || role
   || '><parameter=x>' || turn || '</parameter></function></tool_call>' || text
 ELSE text END"""


def raw_sql(source: str) -> str:
    return f"SELECT conv_id, turn, role, {_RAW} AS raw FROM {source}"


def turns(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr(_RAW.replace("\\", "\\\\")).alias("raw")
    return heavy(spark, sf, "conversations").select("conv_id", "turn", "role", raw)


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    return C.first_call(C.extract_calls(turns(spark, sf), "raw"))


def _key(df: DataFrame, *columns) -> DataFrame:
    return df.select("conv_id", "turn", *columns)


def _text(path: str, value: str = "call.arguments"):
    return F.try_variant_get(F.col(value), path, "string")


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return _key(turns(spark, sf), C.clean_marks(F.col("raw")).alias("clean"))


def thinking(spark: SparkSession, sf: str) -> DataFrame:
    t = turns(spark, sf).withColumn("clean", C.clean_marks(F.col("raw")))
    return _key(t, C.thinking_of(F.col("clean")).alias("thinking"),
                C.without_thinking(F.col("clean")).alias("body"))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    t = turns(spark, sf).withColumn("body", C.without_thinking(C.clean_marks(F.col("raw"))))
    return _key(t, F.posexplode(C.call_blocks(F.col("body"))).alias("pos", "block"))


def xml_calls(spark: SparkSession, sf: str) -> DataFrame:
    one = _extracted(spark, sf).select("conv_id", "turn", F.inline("calls"))
    return _key(one.filter(F.col("raw").startswith("<function")), "name",
                *[_text(f"$.{p}", "arguments").alias(p)
                  for p in ("sql", "purpose", "root_cause_dimension", "key_findings", "x")])


def json_calls(spark: SparkSession, sf: str) -> DataFrame:
    one = _extracted(spark, sf).select("conv_id", "turn", F.inline("calls"))
    return _key(one.filter(F.col("raw").startswith("{")), "name", "malformed",
                _text("$.query", "arguments").alias("query"),
                F.try_variant_get("arguments", "$.top_k", "int").alias("top_k"))


def loose_calls(spark: SparkSession, sf: str) -> DataFrame:
    e = _extracted(spark, sf).filter(F.array_contains("warnings", "unclosed_call"))
    return _key(e, F.col("call.name").alias("name"), _text("$.sql").alias("sql"))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _key(_extracted(spark, sf), C.call_outcome(F.col("call")).alias("outcome"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    e = _extracted(spark, sf).filter("call.name = 'final_answer'")
    checked = e.withColumn("c", C.check_answer(F.col("call.arguments")))
    return _key(checked, "c.status", F.array_join("c.missing", ",").alias("missing"), "c.bad_index")


QUERIES = {
    "E1_clean_marks": clean,
    "E2_thinking": thinking,
    "E3_call_blocks": blocks,
    "E4_xml_calls": xml_calls,
    "E5_json_calls": json_calls,
    "E6_unclosed_calls": loose_calls,
    "E7_plain_text": lambda s, d: _key(_extracted(s, d), "plain"),
    "E8_warnings": lambda s, d: _key(_extracted(s, d), F.array_join("warnings", "|").alias("warnings")),
    "E9_first_call": lambda s, d: _key(
        _extracted(s, d), F.coalesce("call.name", F.lit("")).alias("name"), "extra_calls"),
    "E10_call_outcome": outcomes,
    "E11_answer_check": answers,
}

_RAWS = f"({raw_sql('conversations')})"
_CLEAN = r"regexp_replace(regexp_replace(raw, '<\|(?:im_start|im_end)\|>', '', 'g'), '^\s+|\s+$', '', 'g')"
_THINK = r"(?is)<think\b[^>]*>(.*?)</think\s*>"
_BODY = (rf"regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '{_THINK}', ' ', 'g'), "
         r"'(?is)<think\b[^>]*>.*', ' '), '^\s+|\s+$', '', 'g')")
_BLOCK = r"(?is)<tool_call\b[^>]*>(.*?)</tool_call\s*>"
_KIND = "(conv_id + turn) % 8"

ORACLES = {
    "E1_clean_marks": f"SELECT conv_id, turn, {_CLEAN} AS clean FROM {_RAWS}",
    "E2_thinking": f"""
SELECT conv_id, turn, {_BODY} AS body, CASE WHEN {_KIND} IN (0, 2)
  THEN trim(regexp_extract(raw, '{_THINK}', 1)) END AS thinking FROM {_RAWS}""",
    "E3_call_blocks": f"""
SELECT conv_id, turn, CAST(pos - 1 AS INTEGER) AS pos, trim(l[pos]) AS block FROM (
  SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS pos FROM (
    SELECT *, regexp_extract_all({_BODY}, '{_BLOCK}', 1) AS l FROM {_RAWS}))""",
    "E4_xml_calls": f"""
SELECT conv_id, turn, CASE {_KIND} WHEN 0 THEN 'execute_sql' WHEN 4 THEN 'final_answer' ELSE role END AS name,
  CASE {_KIND} WHEN 0 THEN 'SELECT ' || turn END AS sql, CASE {_KIND} WHEN 0 THEN role END AS purpose,
  CASE {_KIND} WHEN 4 THEN role END AS root_cause_dimension,
  CASE WHEN {_KIND} = 4 THEN CASE conv_id % 3 WHEN 0 THEN '[{{"claim":"c","value":' || turn || '}}]'
    WHEN 1 THEN '[]' ELSE '[{{"claim":"c","value":1}},{{"claim":"d"}}]' END END AS key_findings,
  CASE {_KIND} WHEN 6 THEN CAST(turn AS VARCHAR) END AS x
FROM conversations WHERE {_KIND} IN (0, 4, 6)""",
    "E5_json_calls": f"""
SELECT conv_id, turn, CASE {_KIND} WHEN 1 THEN 'retrieve_context' ELSE '' END AS name, {_KIND} = 6 AS malformed,
  CASE {_KIND} WHEN 1 THEN role END AS query, CASE {_KIND} WHEN 1 THEN CAST(turn AS INTEGER) END AS top_k
FROM conversations WHERE {_KIND} IN (1, 6)""",
    "E6_unclosed_calls": f"""
SELECT conv_id, turn, 'execute_sql' AS name, 'SELECT ' || conv_id AS sql FROM conversations WHERE {_KIND} = 5""",
    "E7_plain_text": rf"""
SELECT conv_id, turn, trim(regexp_replace(CASE {_KIND} WHEN 3 THEN text || ' I should call execute_sql now'
  WHEN 4 THEN '' WHEN 5 THEN '' ELSE text END, '\s+', ' ', 'g')) AS plain FROM conversations""",
    "E8_warnings": f"""
SELECT conv_id, turn, CASE {_KIND} WHEN 2 THEN 'empty_block|unparsable_block: ' || role
  WHEN 3 THEN 'tool_without_call: execute_sql' WHEN 5 THEN 'unclosed_call' ELSE '' END AS warnings
FROM conversations""",
    "E9_first_call": f"""
SELECT conv_id, turn, CASE {_KIND} WHEN 0 THEN 'execute_sql' WHEN 1 THEN 'retrieve_context'
  WHEN 4 THEN 'final_answer' WHEN 5 THEN 'execute_sql' ELSE '' END AS name,
  CASE {_KIND} WHEN 6 THEN 1 ELSE 0 END AS extra_calls FROM conversations""",
    "E10_call_outcome": f"""
SELECT conv_id, turn, CASE WHEN {_KIND} IN (2, 3, 7) THEN 'no_call' WHEN {_KIND} = 6 THEN 'malformed_call'
  ELSE 'dispatched' END AS outcome FROM conversations""",
    "E11_answer_check": f"""
SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'missing_fields' ELSE 'bad_finding' END AS status,
  CASE conv_id % 3 WHEN 1 THEN 'key_findings' END AS missing,
  CASE conv_id % 3 WHEN 2 THEN 1 END AS bad_index FROM conversations WHERE {_KIND} = 4""",
}
