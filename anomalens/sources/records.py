"""JSON and JSONL records: explicit schemas in, counted writes out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

_TEXTS = "array<string>"

CONTEXT_ENTRY = f"id string, kind string, title string, text string, tags {_TEXTS}, tables {_TEXTS}"

REFERENCE = (f"struct<root_cause_dimension string, key_numbers map<string,double>, "
             f"expected_sql_fragments {_TEXTS}>")

TASK = f"task_id string, question string, reference {REFERENCE}, meta variant"

TOOL_CALL = "struct<name string, arguments variant, malformed boolean, parse_error string>"

PAYLOAD = (f"struct<ok boolean, sql string, columns {_TEXTS}, rows array<{_TEXTS}>, "
           "row_count bigint, truncated boolean, elapsed_ms double, error string, "
           "error_type string, purpose string>")

STEP = (f"struct<turn int, assistant_text string, thinking string, tool_call {TOOL_CALL}, "
        f"tool_result struct<ok boolean, content string, payload {PAYLOAD}, error string, "
        f"terminal boolean>, elapsed_s double, warnings {_TEXTS}>")

ANSWER = ("struct<diagnosis string, root_cause_dimension string, "
          "key_findings array<struct<claim string, value string, evidence_sql string>>, "
          "confidence double>")

BUDGET = "struct<max_turns int, max_sql_calls int, max_context_calls int, max_chars int>"

TRAJECTORY = (f"task_id string, question string, messages array<struct<role string, content string>>, "
              f"steps array<{STEP}>, final_answer {ANSWER}, terminated_reason string, error string, "
              f"budget {BUDGET}, reference {REFERENCE}, meta variant, created_at double")


# Session records of a file that is written.
FILE_ROWS = 10_000


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType,
               multi_line: bool = False) -> DataFrame:
    """JSON records with a given schema: blank lines are skipped, a missing path
    is an empty table, a line that is no record fails the read."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multi_line)
    try:
        return reader.json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _write(df: DataFrame, path: str, mode: str, **options: str | int) -> int:
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.mode(mode).options(ignoreNullFields=False, **options).json(path)
    return seen.get["n"]


def write_jsonl(df: DataFrame, path: str) -> int:
    """Replace the records at ``path``; the count is observed during the write."""
    return _write(df, path, "overwrite")


def append_jsonl(df: DataFrame, path: str) -> int:
    """Add records to ``path``; returns how many."""
    return _write(df, path, "append")


def read_context(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Context entries of a document ``{"entries": [...]}`` or a bare list, or with
    ``lines`` one entry per line; defaults filled in, a missing file has no
    entries, an entry without an id fails the read. ``ord`` is the entry's own if it
    was written with one; else it grows in document order, which is that of a single
    document (files of lines are scanned in any order)."""
    fields = ["id", "kind", "title", "text", "tags", "tables", "ord"]
    entry = f"struct<{CONTEXT_ENTRY}, ord bigint>"
    # A bare list is read as one record per element, a document as one record.
    raw = read_jsonl(spark, path, f"entries array<{entry}>, {CONTEXT_ENTRY}, ord bigint", multi_line=not lines)
    single = F.when(F.coalesce(*[F.col(c).cast("string") for c in fields]).isNotNull(),
                    F.array(F.struct(*fields)).cast(f"array<{entry}>"))
    rows = raw.select(F.explode(F.coalesce("entries", single)).alias("e")).select("e.*")
    rows = rows.withColumn("ord", F.coalesce("ord", F.monotonically_increasing_id()))
    named = F.coalesce("id", F.raise_error(F.lit("context entry without an id")).cast("string"))
    return context_defaults(rows.withColumn("id", named))


def context_defaults(df: DataFrame) -> DataFrame:
    empty = F.array().cast(_TEXTS)
    return df.withColumns({
        "kind": F.coalesce("kind", F.lit("metric")),
        "title": F.coalesce("title", F.lit("")),
        "text": F.coalesce("text", F.lit("")),
        "tags": F.coalesce("tags", empty),
        "tables": F.coalesce("tables", empty),
    })


def write_context(df: DataFrame, path: str) -> int:
    """Write entries one per line (``read_context(..., lines=True)`` reads them), with
    their place ``ord``; a single document would have to pass through one task."""
    cols = [c for c in ("id", "kind", "title", "text", "tags", "tables", "ord") if c in df.columns]
    return write_jsonl(df.select(*cols), path)


def write_trajectories(df: DataFrame, path: str) -> int:
    """Replace the session records at ``path``, gzipped: a record has its whole session in
    its line, and field names, statements and results repeat. A gzipped file is one task's
    work to read, so it has at most ``FILE_ROWS`` records."""
    return _write(df, path, "overwrite", compression="gzip", maxRecordsPerFile=FILE_ROWS)


def read_trajectories(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Session records. ``task_id`` repeats across runs, and runs may even be equal, so
    ``traj_id`` names the place of the record: its file, the part of the file and the
    row in the scan. Scans with equal split settings give equal names."""
    df = read_jsonl(spark, path, TRAJECTORY, multi_line)
    source = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start").cast("string")] if df.inputFiles() else []
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).cast("string")
    key = F.sha2(F.concat_ws("\x1f", *source, row, "task_id", F.col("created_at").cast("string")), 256)
    return df.select(key.alias("traj_id"), "*")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, TASK)


def write_rewards(scored: DataFrame, path: str) -> int:
    """Score rows, every component rounded to 6 decimals."""
    doubles = {f.name: F.round(f.name, 6) for f in scored.schema.fields
               if isinstance(f.dataType, T.DoubleType)}
    return write_jsonl(scored.withColumns(doubles), path)
