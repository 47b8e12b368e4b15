"""Sources, sinks and profiles over the driver's tables.

The tables come as Parquet; CSV and JSON inputs are written from them into the
session's shared scratch folder first and then read back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from anomalens.operators import profile as P
from anomalens.plans.storage import scratch_path
from anomalens.sources import records as R, tables as S
from workload.tables import NAMES, heavy, table


def _flat(df: DataFrame) -> DataFrame:
    """A list has no place in a CSV cell; it becomes JSON."""
    return df.withColumns({f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)})


def _csv_dir(spark: SparkSession, sf: str) -> str:
    root = scratch_path(spark, "csv")
    for name in NAMES:
        S.write_csv(_flat(table(spark, sf, name)), f"{root}/{name}.csv")
    return root


def _summary(df: DataFrame, name: str) -> DataFrame:
    """Rows, distinct rows and non-null cells of a table, comparable in any engine."""
    cells = reduce(lambda a, b: a + b, [F.count(c) for c in df.columns])
    return df.agg(F.count("*").alias("row_count"), cells.alias("cell_count")).select(
        F.lit(name).alias("table_name"), "row_count", "cell_count")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    root = _csv_dir(spark, sf)
    return _union([_summary(S.read_csv(spark, f"{root}/{n}.csv"), n)
                   for n in S.csv_tables(spark, root)])


def csv_override(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "csv")
    codes = table(spark, sf, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("code"), "c_custkey", "c_acctbal")
    S.write_csv(codes, f"{root}/codes.csv")
    return S.read_csv(spark, f"{root}/codes.csv", {"code": "STRING"}).select(
        "code", "c_custkey", "c_acctbal")


def _loaded(spark: SparkSession, sf: str) -> tuple[str, list[str]]:
    name = scratch_path(spark, "db").rsplit("/", 1)[1].replace("-", "_")
    return name, S.load_csvs(spark, _csv_dir(spark, sf), name, scratch_path(spark, name))


def materialise(spark: SparkSession, sf: str) -> DataFrame:
    name, names = _loaded(spark, sf)
    return _union([_summary(spark.table(f"{name}.{t}"), t) for t in names])


def csv_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with quotes, separators and line breaks, through CSV and back, value by
    value."""
    root = scratch_path(spark, "texts")
    docs, talks = table(spark, sf, "documents"), table(spark, sf, "conversations")
    S.write_csv(docs.select("doc_id", "text", "source"), f"{root}/my documents.csv")
    S.write_csv(talks.select("conv_id", "turn", F.concat(F.lit('say "'), "text", F.lit('",\n ')).alias("text"), "role"),
                f"{root}/talks.csv")
    docs, talks = (S.read_csv(spark, f"{root}/{n}.csv") for n in S.csv_tables(spark, root))
    return docs.select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("turn"),
                       F.md5("text").alias("digest"), F.col("source").alias("label")).unionByName(
        talks.select(F.lit("conversations").alias("table_name"), F.col("conv_id").alias("id"), "turn",
                     F.md5("text").alias("digest"), F.col("role").alias("label")))


_EVENT = "event_id bigint, user_id bigint, event_type string, value double"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


def jsonl_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "events.jsonl")
    R.write_jsonl(_events(spark, sf), path)
    return R.read_jsonl(spark, path, _EVENT)


def jsonl_write(spark: SparkSession, sf: str) -> DataFrame:
    """Two overwriting writes: the second replaces the first."""
    path = scratch_path(spark, "events.jsonl")
    R.write_jsonl(_events(spark, sf), path)
    n = R.write_jsonl(_events(spark, sf).filter("event_type = 'click'"), path)
    return R.read_jsonl(spark, path, _EVENT).agg(
        F.count("*").alias("n"), F.sum("value").alias("total")).withColumn("written", F.lit(n))


def jsonl_append(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "events.jsonl")
    R.append_jsonl(_events(spark, sf), path)
    n = R.append_jsonl(_events(spark, sf).filter("event_type = 'click'"), path)
    return R.read_jsonl(spark, path, _EVENT).groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")).withColumn("appended", F.lit(n))


def document_entries(spark: SparkSession, sf: str) -> DataFrame:
    """documents as context entries: title = source, tag = language."""
    return heavy(spark, sf, "documents").select(
        F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("lang") == "en", "metric").otherwise("table_note").alias("kind"),
        F.col("source").alias("title"), "text",
        F.array("lang").alias("tags"), F.array("source").alias("tables"),
        F.col("doc_id").alias("ord"))


def context_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "context")
    R.write_context(document_entries(spark, sf), path)
    e = R.read_context(spark, path, lines=True)
    return e.select("id", "kind", "title", "ord", F.md5("text").alias("digest"),
                    F.array_join("tags", ",").alias("tags"), F.array_join("tables", ",").alias("tables"))


def list_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The loaded tables with their row counts."""
    name, _ = _loaded(spark, sf)
    counts = _with_table({n: P.row_count(spark.table(f"{name}.{n}")) for n in NAMES})
    return S.list_tables(spark, name).join(counts, "table_name")


def _all(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf, n) for n in NAMES}


def _value_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Non-null values of every column."""
    frames = []
    for name, df in _all(spark, sf).items():
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).isNotNull().alias("v")) for c in df.columns])
        frames.append(df.select(F.lit(name).alias("table_name"), F.inline(cells)))
    return _union(frames).groupBy("table_name", "column_name").agg(F.count_if("v").alias("n_values"))


def column_types(spark: SparkSession, sf: str) -> DataFrame:
    """Columns with the type family both engines share, and how many values they hold."""
    listing = S.schema_listing(spark, _all(spark, sf))
    t = F.col("data_type")
    family = (F.when(t.startswith("array"), "list").when(t.isin("bigint", "int"), "integer").when(t == "double", "double")
              .when(t.startswith("timestamp"), "timestamp").otherwise("text"))
    return listing.select("table_name", "column_name", family.alias("family")).join(
        _value_counts(spark, sf), ["table_name", "column_name"])


def schema_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The listing next to the rows of each table."""
    counts = _with_table({n: P.row_count(df) for n, df in _all(spark, sf).items()})
    return S.schema_listing(spark, _all(spark, sf)).drop("data_type", "nullable").join(counts, "table_name")


def _shown(df: DataFrame) -> DataFrame:
    """Samples as one text. Engines print floats of lists differently; those are counted."""
    text = F.array_join("sample_values", "|")
    return df.withColumn("sample_values", F.when(
        F.col("column_name") == "embedding", F.size("sample_values").cast("string")).otherwise(text))


def profiled(spark: SparkSession, sf: str) -> DataFrame:
    return P.profile_tables(_all(spark, sf))


def summary(spark: SparkSession, sf: str) -> DataFrame:
    """All tables. Engines print floats of lists differently; those are left out."""
    out = P.summarize_tables(_all(spark, sf)).drop("approx_unique")
    plain = F.col("column_name") != "embedding"
    return out.withColumns({c: F.when(plain, F.col(c)) for c in ("min", "max")})


def _with_table(frames: dict[str, DataFrame]) -> DataFrame:
    return _union([df.withColumn("table_name", F.lit(n)) for n, df in frames.items()])


def profile_entries(spark: SparkSession, sf: str) -> DataFrame:
    e = P.profile_entries(P.listed_tables(_all(spark, sf)))
    return e.select("id", "kind", "title", F.regexp_extract("text", r"^(\d+) rows", 1).alias("rows"),
                    F.array_join("tags", ",").alias("tags"), F.array_join("tables", ",").alias("tables"))


QUERIES = {
    "A1_csv_directory_scan": csv_scan,
    "A2_csv_type_override": csv_override,
    "A3_materialise_tables": materialise,
    "A4_csv_sink": csv_sink,
    "A5_jsonl_scan": jsonl_scan,
    "A6_jsonl_overwrite": jsonl_write,
    "A7_jsonl_append": jsonl_append,
    "A8_context_document": context_scan,
    "B1_list_tables": list_tables,
    "B2_column_types": column_types,
    "B3_schema_listing": schema_listing,
    "B4_row_count": lambda s, d: _with_table({n: P.row_count(df) for n, df in _all(s, d).items()}),
    "B5_null_ratio": lambda s, d: _with_table({n: P.null_ratios(df) for n, df in _all(s, d).items()}),
    "B6_distinct_count": lambda s, d: P.profile_tables(_all(s, d), sample_n=0).select(
        "table_name", "column_name", "distinct_count"),
    "B7_sample_values": lambda s, d: _shown(_with_table({n: P.samples(df) for n, df in _all(s, d).items()})),
    "B8_profile": lambda s, d: _shown(profiled(s, d).drop("data_type")),
    "B9_summarize": summary,
    "B10_profile_entries": profile_entries,
}


_COLUMNS = {
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "nation": "n_nationkey n_name n_regionkey",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "region": "r_regionkey r_name",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "labels": "doc_id quality toxic",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice "
                "l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "conversations": "conv_id turn role text",
}


def _per_column(select: str, names=NAMES) -> str:
    """One SELECT per table and column ({t}, {c}, {i}, {sample})."""
    return "\nUNION ALL\n".join(
        select.format(t=t, c=c, i=i, sample=(_LISTED if c == "embedding" else _SAMPLE).format(t=t, c=c))
        for t in names for i, c in enumerate(_COLUMNS[t].split()))


_SAMPLE = ("(SELECT coalesce(string_agg(CAST(v AS VARCHAR), '|' ORDER BY v), '') FROM (SELECT DISTINCT {c} AS v FROM {t} "
           "WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 5))")
_LISTED = "(SELECT CAST(least(5, count(DISTINCT {c})) AS VARCHAR) FROM {t})"


_SUMMARY_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, "
    f"{' + '.join(f'count({c})' for c in _COLUMNS[t].split())} AS cell_count FROM {t}" for t in NAMES)

_NULLS = "CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER ({c} IS NULL) / count(*) END"
_EVENT_SQL = "SELECT event_id, user_id, event_type, value FROM events"
_SCHEMA_SQL = ("FROM information_schema.columns WHERE table_name IN ("
               + ", ".join(f"'{n}'" for n in NAMES) + ")")

_NUMBERS = set("""c_custkey c_nationkey c_acctbal n_nationkey n_regionkey o_orderkey o_custkey o_totalprice p_partkey
p_size p_retailprice r_regionkey s_suppkey s_nationkey s_acctbal doc_id quality toxic l_orderkey l_partkey l_suppkey
l_linenumber l_quantity l_extendedprice l_discount l_tax event_id user_id value n_chars vec_id label page_id item_id
conv_id turn""".split())
_NO_NUMBERS = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("avg", "std", "q25", "q50", "q75"))
_QUARTILES = ", ".join(f"CAST(quantile_disc({{c}}, {q}) AS DOUBLE) AS {n}"
                       for n, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)))
_SUMMARIZE_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, {i} AS ordinal, '{c}' AS column_name, "
    + ", ".join("CAST(NULL AS VARCHAR) AS " + f if c == "embedding" else f"CAST({f}({c}) AS VARCHAR) AS {f}"
                for f in ("min", "max")) + ", "
    + (f"CAST(avg({c}) AS DOUBLE) AS avg, stddev_samp({c}) AS std, {_QUARTILES.format(c=c)}, "
       if c in _NUMBERS else f"{_NO_NUMBERS}, ")
    + f"count(*) AS row_count, 100.0 * count(*) FILTER ({c} IS NULL) / count(*) AS null_percentage FROM {t}"
    for t in NAMES for i, c in enumerate(_COLUMNS[t].split()))
_VALUES_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS n_values FROM {t}"
    for t in NAMES for c in _COLUMNS[t].split())
_ROWS_SQL = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in NAMES)

ORACLES = {
    "A1_csv_directory_scan": _SUMMARY_SQL,
    "A2_csv_type_override": """
SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS code, c_custkey, c_acctbal FROM customer""",
    "A3_materialise_tables": _SUMMARY_SQL,
    "A4_csv_sink": """
SELECT 'documents' AS table_name, doc_id AS id, 0::BIGINT AS turn, md5(text) AS digest, source AS label FROM documents
UNION ALL SELECT 'conversations', conv_id, turn, md5('say "' || text || '",' || chr(10) || ' '), role
FROM conversations""",
    "A5_jsonl_scan": _EVENT_SQL,
    "A6_jsonl_overwrite": f"""
SELECT count(*) AS n, sum(value) AS total, CAST(count(*) AS INTEGER) AS written
FROM ({_EVENT_SQL}) WHERE event_type = 'click'""",
    "A7_jsonl_append": f"""
WITH c AS (SELECT * FROM ({_EVENT_SQL}) WHERE event_type = 'click'),
a AS (SELECT * FROM ({_EVENT_SQL}) UNION ALL SELECT * FROM c)
SELECT event_type, count(*) AS n, sum(value) AS total,
  CAST((SELECT count(*) FROM c) AS INTEGER) AS appended FROM a GROUP BY 1""",
    "A8_context_document": """
SELECT 'doc.' || doc_id AS id, CASE WHEN lang = 'en' THEN 'metric' ELSE 'table_note' END AS kind,
  source AS title, doc_id AS ord, md5(text) AS digest, lang AS tags, source AS tables FROM documents""",
    "B1_list_tables": _ROWS_SQL,
    "B2_column_types": f"""
SELECT table_name, column_name, CASE WHEN data_type LIKE '%[]' THEN 'list'
  WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN data_type = 'DOUBLE' THEN 'double'
  WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp' ELSE 'text' END AS family, n_values
FROM (SELECT * {_SCHEMA_SQL}) JOIN ({_VALUES_SQL}) USING (table_name, column_name)""",
    "B3_schema_listing": f"""
SELECT table_name, CAST(ordinal_position - 1 AS INTEGER) AS ordinal, column_name, row_count
FROM (SELECT * {_SCHEMA_SQL}) JOIN ({_ROWS_SQL}) USING (table_name)""",
    "B4_row_count": "\nUNION ALL\n".join(
        f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in NAMES),
    "B5_null_ratio": _per_column(
        f"SELECT '{{t}}' AS table_name, '{{c}}' AS column_name, {_NULLS} AS null_ratio FROM {{t}}"),
    "B6_distinct_count": _per_column(
        "SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM {t}"),
    "B7_sample_values": _per_column(
        "SELECT '{t}' AS table_name, '{c}' AS column_name, {sample} AS sample_values"),
    "B8_profile": _per_column(
        f"SELECT '{{t}}' AS table_name, {{i}} AS ordinal, '{{c}}' AS column_name, count(*) AS row_count, "
        f"{_NULLS} AS null_ratio, count(DISTINCT {{c}}) AS distinct_count, {{sample}} AS sample_values FROM {{t}}"),
    "B9_summarize": _SUMMARIZE_SQL,
    "B10_profile_entries": "\nUNION ALL\n".join(
        f"SELECT 'profile.{t}' AS id, 'table_note' AS kind, 'Columns of table {t}' AS title, "
        f"CAST(count(*) AS VARCHAR) AS rows, '{t},{','.join(_COLUMNS[t].split())}' AS tags, "
        f"'{t}' AS tables FROM {t}" for t in NAMES),
}
