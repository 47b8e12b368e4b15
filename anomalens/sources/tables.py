"""CSV directories in, catalog tables out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F, types as T

# Quotes are doubled, blanks are data.
_CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False}
# Rows of a file that is written.
FILE_ROWS = 10_000


def csv_tables(spark: SparkSession, raw_dir: str) -> list[str]:
    """Names of the ``*.csv`` files or folders of a directory, in name order. The
    listing comes from the file source's metadata (which gives encoded paths); no
    file is opened."""
    root = raw_dir.rstrip("/")
    try:
        files = spark.read.format("binaryFile").load(f"{root}/*.csv")
        names = files.select(
            F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.csv(?:/[^/]*)?$", 1).alias("n")
        ).distinct().collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        names = []
    if not names:
        raise FileNotFoundError(f"no CSV files in {raw_dir}")
    return sorted(unquote(r.n) for r in names)


def _reader(spark: SparkSession, multi_line: bool) -> DataFrameReader:
    # An empty cell is NULL, a quoted empty one is an empty text.
    return spark.read.options(**_CSV).option("nullValue", "\u0000").option("multiLine", multi_line)


def csv_schema(spark: SparkSession, path: str, types: Mapping[str, str] | None = None,
               multi_line: bool = True) -> T.StructType:
    """Schema from the header and all rows, whole numbers as BIGINT and timestamps
    without zone; ``types`` (column to SQL type) wins over inference."""
    inferred = _reader(spark, multi_line).option("inferSchema", True).csv(path).schema
    widened = {T.IntegerType(): T.LongType(), T.TimestampType(): T.TimestampNTZType()}
    fields = []
    for f in inferred.fields:
        kind = (types or {}).get(f.name)
        data_type = _sql_type(spark, kind) if kind else widened.get(f.dataType, f.dataType)
        fields.append(T.StructField(f.name, data_type, True))
    return T.StructType(fields)


def _sql_type(spark: SparkSession, name: str) -> T.DataType:
    return spark.sql(f"SELECT CAST(NULL AS {name}) AS c").schema["c"].dataType


def read_csv(spark: SparkSession, path: str, types: Mapping[str, str] | None = None,
             multi_line: bool = True) -> DataFrame:
    """One CSV table. The inferred schema is explicit at read time, so codes with
    leading zeros keep an overriding STRING type, and a row that does not fit fails
    the read instead of becoming NULL.

    ``multi_line`` allows line breaks inside quotes; a file is then one task's work.
    Without such breaks switch it off, and large files are split."""
    schema = csv_schema(spark, path, types, multi_line)
    return _reader(spark, multi_line).schema(schema).option("mode", "FAILFAST").csv(path)


def load_csvs(spark: SparkSession, raw_dir: str, database: str, location: str | None = None,
              overwrite: bool = True, types: Mapping[str, Mapping[str, str]] | None = None,
              multi_line: bool = True) -> list[str]:
    """Materialise every CSV of a directory as a Parquet table of ``database``.

    ``overwrite`` drops the whole database first; without it only tables of the
    same name are replaced. Returns the table names.
    """
    names = csv_tables(spark, raw_dir)
    if overwrite:
        spark.sql(f"DROP DATABASE IF EXISTS `{database}` CASCADE")
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{at}")
    for name in names:
        df = read_csv(spark, f"{raw_dir.rstrip('/')}/{name}.csv", (types or {}).get(name), multi_line)
        df.write.mode("overwrite").format("parquet").saveAsTable(f"`{database}`.`{name}`")
    return names


def write_csv(df: DataFrame, path: str) -> None:
    """Values with quotes, separators or line breaks are quoted, quotes doubled. A file
    has at most ``FILE_ROWS`` rows: with such breaks it is one task's work to read."""
    df.write.mode("overwrite").options(**_CSV).option("maxRecordsPerFile", FILE_ROWS).csv(path)


def list_tables(spark: SparkSession, database: str) -> DataFrame:
    """Tables of a database, in name order."""
    return spark.sql(f"SHOW TABLES IN `{database}`").select(
        F.col("tableName").alias("table_name")).orderBy("table_name")


def column_types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def schema_listing(spark: SparkSession, tables: Mapping[str, DataFrame],
                   only: Sequence[str] | None = None) -> DataFrame:
    """One row per table and column: position, name, type, nullable. Built from
    schemas, so no data is read."""
    rows = [(t, i, f.name, f.dataType.simpleString(), f.nullable)
            for t, df in tables.items() if not only or t in only
            for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(
        rows, "table_name string, ordinal int, column_name string, data_type string, nullable boolean")
