"""A query log derived from ``events``, and the text functions over it.

The tables hold no SQL, so every event is turned into one call of a session: the
user is the session, the event id its position. The same expression text runs in
both engines. The templates have less than 0.4 in common with each other, so two
calls are similar exactly if their number-masked forms are equal, which SQL can
follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from anomalens.config import ALLOWED_STATEMENTS, FORBIDDEN_FUNCTIONS, FORBIDDEN_KEYWORDS
from anomalens.functions import similarity as M, sqltext as S, tokens as T, values as V
from anomalens.operators import querylog as Q
from workload.tables import heavy, table

# {k} is the number in props. chr(10) is a line break, chr(39) a quote.
_TEXT = """
CASE event_type
 WHEN 'click' THEN 'SELECT region ,  SUM( gmv ) FROM sales WHERE day = ' || {k} || ' /* drop ' || {k} || ' */ GROUP BY 1'
 WHEN 'view' THEN 'from t_' || chr(39) || 'it' || chr(39) || chr(39) || 's; drop' || chr(39) || ' limit ' || {k} || ' ;'
 WHEN 'purchase' THEN 'WITH x AS (VALUES (' || {k} || ')) -- update it' || chr(10) || ' TABLE x'
 WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'VACUUM jobs ' || {k}
                         WHEN event_id % 3 = 1 THEN 'SHOW tables; SHOW ' || {k}
                         ELSE 'VALUES (glob ( ' || chr(39) || {k} || chr(39) || ') || now())' END
 ELSE CASE WHEN event_id % 4 = 0 THEN '   '
           WHEN event_id % 4 = 1 THEN '(describe "set" ) load ' || {k}
           WHEN event_id % 4 = 2 THEN 'EXPLAIN ANALYZE "update" , ' || {k} || '.50'
           ELSE '-- ' || {k} END
END"""


def log_sql(engine: str) -> str:
    """SELECT of the derived log: session, position, text, outcome."""
    k = "regexp_extract(props, '([0-9]+)', 1)"
    text = _TEXT.replace("{k}", k)
    return f"""
SELECT user_id AS traj_id, event_id AS turn, value, {text} AS sql,
  CASE WHEN event_id % 10 = 7 THEN NULL WHEN event_id % 10 = 3 THEN 'retrieve_context'
       WHEN event_id % 10 = 9 THEN 'final_answer' ELSE 'execute_sql' END AS tool_name,
  CASE WHEN value > 30 THEN 'over_budget' END AS error,
  CASE WHEN event_type = 'signup' THEN 'illegal' WHEN event_id % 7 = 0 THEN 'timeout'
       WHEN event_id % 5 = 0 THEN 'execution' END AS error_type
FROM {"{events}" if engine == "spark" else "events"}"""


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    log = spark.sql(log_sql("spark"), events=heavy(spark, sf, "events"))
    return log.withColumn("ok", F.when(F.col("tool_name").isNotNull(), F.col("error_type").isNull()))


def _with(column):
    """Query that adds one column ``out`` to (turn) of the log."""
    return lambda s, d: query_log(s, d).select("turn", column(F.col("sql")).alias("out"))


# Appended to a form; it shares no character run with one that could match twice.
_SUFFIX = "repeat('~', CAST(turn % 100 AS INT))"


def similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Every call against itself with up to 99 characters behind it. For forms under
    200 characters the ratio is then 2a / (2a + b), all values between 0 and 1."""
    log = query_log(spark, sf)
    longer = F.concat(S.normalize(F.col("sql")), F.expr(_SUFFIX))
    return log.select("turn", M.sql_similarity(F.col("sql"), longer).alias("similarity"))


def match(spark: SparkSession, sf: str) -> DataFrame:
    """Document sources against language names: containment decides or nothing
    is shared, so SQL can follow."""
    d = table(spark, sf, "documents")
    pred = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" Language "), F.upper("lang"))).when(
        F.col("doc_id") % 3 == 1, F.lit("42")).otherwise(F.lit("  "))
    return d.select("doc_id", M.text_match(pred, F.col("lang")).alias("score"))


def numbers(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    other = F.col("value") * (1 + (F.col("event_id") % 5 - 2) * 0.0051)
    text = F.when(F.col("event_id") % 11 == 0, F.lit("n/a")).otherwise(other.cast("string"))
    return e.select("event_id", V.numeric_close(F.col("value"), text).alias("close"))


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = heavy(spark, sf, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"),
                    F.size(F.array_distinct("t")).alias("n_distinct"), F.array_min("t").alias("first"))


def coerced(spark: SparkSession, sf: str) -> DataFrame:
    """Parameter texts of every kind, typed and printed as JSON."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    raw = (F.when(i % 7 == 0, F.concat(F.lit(" "), i.cast("string"), F.lit(chr(10))))
           .when(i % 7 == 1, F.lit("True")).when(i % 7 == 2, F.lit(" none "))
           .when(i % 7 == 3, F.col("props"))
           .when(i % 7 == 4, F.concat(F.lit("[{'k': "), i.cast("string"), F.lit(", 'ok': True}]")))
           .when(i % 7 == 5, F.concat(i.cast("string"), F.lit(".25")))
           .when(i % 14 == 6, F.lit('[1, NaN, {"a": 1, "a": 2}]'))
           .otherwise(F.concat(F.lit("[broken "), F.col("event_type"))))
    return e.select("event_id", F.to_json(V.coerce_value(raw)).alias("json"))


QUERIES = {
    "D1_strip_noise": _with(S.strip_noise),
    "D2_split_statements": _with(lambda c: F.array_join(S.split_statements(c), "|")),
    "D3_first_keyword": _with(S.first_keyword),
    "D4_forbidden_keyword": _with(S.find_forbidden),
    "D5_forbidden_function": _with(S.find_forbidden_function),
    "D6_legality_verdict": lambda s, d: Q.audit(query_log(s, d)).select("turn", "verdict", "hit"),
    "D7_outcome_tally": lambda s, d: Q.outcome_tally(query_log(s, d)),
    "D8_normal_form": lambda s, d: Q.normalized(query_log(s, d)).select("turn", "form", "masked_form"),
    "D9_sql_similarity": similarity,
    "D10_text_match": match,
    "D11_numeric_close": numbers,
    "D12_tokenize": tokens,
    "D13_coerce_value": coerced,
}

LOG = (f"(SELECT *, CASE WHEN tool_name IS NOT NULL THEN error_type IS NULL END AS ok "
       f"FROM ({log_sql('duckdb')}))")

_STRIP = "sql"
for _p, _r in ((r"\$\$[\s\S]*?\$\$", "''''"), (r"/\*[\s\S]*?\*/", "' '"), (r"--[^\n]*", "' '"),
               ("''(?:[^'']|'''')*''", "''''''"), ('"(?:[^"]|"")*"', "'\"\"'")):
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', {_r}, 'g')"
_TRIMMED = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_BODY = f"(SELECT *, {_STRIP} AS body FROM {LOG})"
_PARTS = ("list_filter(list_transform(string_split(body, ';'), lambda p: " + _TRIMMED.format(x="p")
          + "), lambda p: p <> '')")
_KEYWORD = r"upper(regexp_extract(body, '^\s*[( \t\r\n]*([A-Za-z_][A-Za-z0-9_]*)', 1))"

_WORD_HIT = "CASE " + " ".join(
    rf"WHEN regexp_matches(body, '\b{w}\b', 'i') THEN '{w}'" for w in FORBIDDEN_KEYWORDS) + " END"
_FUNC_HIT = "CASE " + " ".join(
    rf"WHEN regexp_matches(body, '\b{w}\s*\(', 'i') THEN '{w}'" for w in FORBIDDEN_FUNCTIONS) + " END"
_ALLOWED = ", ".join(f"'{w}'" for w in ALLOWED_STATEMENTS)
_AUDIT = f"""
SELECT *, CASE WHEN {_TRIMMED.format(x='sql')} = '' THEN 'empty' WHEN n > 1 THEN 'multi_statement'
  WHEN kw NOT IN ({_ALLOWED}) THEN 'kind_not_allowed' WHEN word IS NOT NULL THEN 'banned_keyword'
  WHEN func IS NOT NULL THEN 'banned_function' ELSE 'ok' END AS verdict
FROM (SELECT *, len({_PARTS}) AS n, {_KEYWORD} AS kw, {_WORD_HIT} AS word, {_FUNC_HIT} AS func FROM {_BODY})"""


def form_sql(mask: bool) -> str:
    """Normal form of ``body``."""
    x = r"trim(regexp_replace(lower(body), '\s+', ' ', 'g'))"
    x = f"trim(regexp_replace({x}, '^;+|;+$', '', 'g'))"
    if mask:
        x = rf"regexp_replace({x}, '\b\d+(?:\.\d+)?\b', '?', 'g')"
    for p, r in ((r"\s*,\s*", ","), (r"\(\s*", "("), (r"\s*\)", ")")):
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return x


FORMS = f"(SELECT *, {form_sql(False)} AS form, {form_sql(True)} AS masked_form FROM {_BODY})"

ORACLES = {
    "D1_strip_noise": f"SELECT turn, body AS out FROM {_BODY}",
    "D2_split_statements": f"SELECT turn, array_to_string({_PARTS}, '|') AS out FROM {_BODY}",
    "D3_first_keyword": f"SELECT turn, {_KEYWORD} AS out FROM {_BODY}",
    "D4_forbidden_keyword": f"SELECT turn, {_WORD_HIT} AS out FROM {_BODY}",
    "D5_forbidden_function": f"SELECT turn, {_FUNC_HIT} AS out FROM {_BODY}",
    "D6_legality_verdict": f"""
SELECT turn, verdict, CASE verdict WHEN 'multi_statement' THEN CAST(n AS VARCHAR)
  WHEN 'kind_not_allowed' THEN coalesce(nullif(kw, ''), 'UNKNOWN') WHEN 'banned_keyword' THEN word
  WHEN 'banned_function' THEN func END AS hit FROM ({_AUDIT})""",
    "D7_outcome_tally": f"""
SELECT count(*) AS total, count(*) FILTER (ok) AS ok, count(*) FILTER (error_type = 'illegal') AS illegal,
  count(*) FILTER (error_type = 'timeout') AS timeout,
  count(*) FILTER (error_type = 'execution') AS execution_error FROM {LOG}""",
    "D8_normal_form": f"SELECT turn, form, masked_form FROM {FORMS}",
    "D9_sql_similarity": f"""
SELECT turn, CASE WHEN turn % 100 = 0 AND form = '' THEN 1.0 WHEN form = '' THEN 0.0
  ELSE 2.0 * length(form) / (2.0 * length(form) + turn % 100) END AS similarity FROM {FORMS}""",
    "D10_text_match": """
SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM documents""",
    "D11_numeric_close": """
WITH p AS (SELECT event_id, value AS a, CASE WHEN event_id % 11 <> 0
  THEN value * (1 + (event_id % 5 - 2) * 0.0051) END AS b FROM events)
SELECT event_id, coalesce(a = b OR abs(a - b) <= greatest(1e-9, 0.01 * greatest(abs(a), abs(b))), false)
  AS close FROM p""",
    "D12_tokenize": r"""
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct,
  list_min(t) AS first
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*|\d+') AS t FROM documents)""",
    "D13_coerce_value": """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'true'
  WHEN 2 THEN 'null' WHEN 3 THEN '{"k":' || regexp_extract(props, '([0-9]+)', 1) || '}'
  WHEN 4 THEN '[{"k":' || event_id || ',"ok":true}]' WHEN 5 THEN event_id || '.25'
  ELSE CASE WHEN event_id % 14 = 6 THEN '[1,"NaN",{"a":2}]' ELSE '"[broken ' || event_type || '"' END END AS json
FROM events""",
}
