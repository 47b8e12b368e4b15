"""Column profiles. Counts, NULLs and exact distinct values of all columns of all tables
come from one job, sample values from another pass, quartiles from a few counting passes."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from anomalens.config import SAMPLE_VALUES
from anomalens.plans.storage import cut_lineage

MERGE_TASKS = 16
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
# Parts of a range that one pass of ``exact_ranks`` counts, and rows that end the passes.
RANK_BUCKETS = 4096
RANK_REST = 100_000


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that every column can be compared."""
    return df.select(*[
        F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, _NESTED)
        else F.col(f"`{f.name}`") for f in df.schema.fields])


def _long(row: DataFrame, df: DataFrame, parts: Mapping[str, str]) -> DataFrame:
    """Turn one row of per-column aggregates (``<part>_<ordinal>``) into one row
    per column."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column_name"),
                 *[F.col(f"{p}_{i}").cast(t).alias(p) for p, t in parts.items()])
        for i, f in enumerate(df.schema.fields)])
    keep = [c for c in row.columns if c == "row_count"]
    return row.select(*keep, F.inline(cells))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def null_ratios(df: DataFrame) -> DataFrame:
    """Share of NULLs per column; 0.0 on an empty table."""
    row = df.agg(F.count("*").alias("row_count"), *_null_counts(df))
    return _long(row, df, {"nulls": "bigint"}).select("column_name", _null_ratio().alias("null_ratio"))


def _null_counts(df: DataFrame) -> list[Column]:
    return [F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls_{i}") for i, c in enumerate(df.columns)]


def _null_ratio() -> Column:
    return F.coalesce(F.try_divide("nulls", "row_count"), F.lit(0.0))


def _one_zero(column: str, kind: T.DataType) -> Column:
    c = F.col(f"`{column}`")
    return c + F.lit(0.0).cast(kind) if isinstance(kind, (T.FloatType, T.DoubleType)) else c


def _digest(column: str, kind: T.DataType) -> list[Column]:
    """A value as 128 bits, NULL for NULL. Two hashes of different seeds: numbers of up to
    64 bits never collide, of others a pair does with a chance of 2**-128."""
    c = _one_zero(column, kind)
    return [F.when(c.isNotNull(), h) for h in (F.xxhash64(c), F.xxhash64(F.lit(1), c))]


def _listing(tables: Mapping[str, DataFrame]) -> list[tuple[str, int, str, str]]:
    return [(t, i, c, k) for t, df in tables.items() for i, (c, k) in enumerate(df.dtypes)]


def _columns(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column of the tables, numbered through (``_id``)."""
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(_listing(tables))],
        "_id int, table_name string, ordinal int, column_name string, data_type string")


def _cells(tables: Mapping[str, DataFrame], fields, cell) -> DataFrame:
    """The cells of all tables one below the other: the column's number and what ``cell``
    makes of each column that ``fields`` takes."""
    number = {(t, i): n for n, (t, i, *_) in enumerate(_listing(tables))}
    parts = []
    for t, df in tables.items():
        flat = _flat(df)
        taken = [(i, f) for i, f in enumerate(flat.schema.fields) if fields(f.dataType)]
        if taken:
            parts.append(flat.select(F.inline(F.array(*[
                F.struct(F.lit(number[t, i]).alias("id"), *cell(f)) for i, f in taken]))))
    return reduce(DataFrame.union, parts) if parts else None


def _counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``_columns`` with ``row_count, nulls, distinct_count``. One pass over each table and
    one shuffle for all: cells are counted by (column, digest), rows of fixed width that
    combine map-side."""
    cells = _cells(tables, lambda _: True, lambda f: [
        h.alias(n) for n, h in zip(("h1", "h2"), _digest(f.name, f.dataType))])
    values = cells.groupBy("id", "h1", "h2").agg(F.count("*").alias("n"))
    found = values.groupBy("id").agg(
        F.sum("n").alias("row_count"), F.sum(F.when(F.col("h1").isNull(), F.col("n"))).alias("nulls"),
        F.count("h1").alias("distinct_count"))
    columns = _columns(cells.sparkSession, tables)
    zero = F.lit(0).cast("bigint")
    return columns.join(found, F.col("_id") == F.col("id"), "left").select(
        *columns.columns, *[F.coalesce(c, zero).alias(c) for c in ("row_count", "nulls", "distinct_count")])


def distinct_counts(df: DataFrame, max_distinct_scan: int | None = None,
                    approximate_above: bool = False) -> DataFrame:
    """Exact distinct values per column, NULLs left out. With ``max_distinct_scan`` a
    table of more rows reports -1, or a sketch's estimate with ``approximate_above``."""
    if max_distinct_scan is None or df.count() <= max_distinct_scan:
        return _counts({"": df}).select("column_name", "distinct_count")
    flat = _flat(df)
    aggs = [F.approx_count_distinct(F.col(f"`{c}`")) if approximate_above else F.lit(-1) for c in flat.columns]
    row = flat.agg(F.count("*").alias("row_count"),
                   *[a.alias(f"distinct_count_{i}") for i, a in enumerate(aggs)])
    return _long(row, df, {"distinct_count": "bigint"}).select("column_name", "distinct_count")


def _smallest(n: int):
    """Per task: the n smallest distinct values of every column, as n rows of the
    table's own schema. State is n values per column, whatever the input size."""

    def less(column: pa.Array, state: pa.Array) -> pa.Array:
        """The values that may still enter a full state, most often none."""
        largest = state[-1] if len(state) == n else None
        if largest is None or pa.types.is_boolean(state.type) or largest.as_py() != largest.as_py():
            return column
        return column.filter(pc.less(column, largest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, arrow = None, None
        for batch in batches:
            arrow = batch.schema
            columns = [batch.column(i) for i in range(batch.num_columns)]
            if state is not None:
                columns = [pa.concat_arrays([s, less(c, s)]) for s, c in zip(state, columns)]
            state = []
            for c in columns:
                u = pc.drop_null(pc.unique(c))
                state.append(u.take(pc.array_sort_indices(u)[:n]))
        if state is not None:
            padded = [pa.concat_arrays([s, pa.nulls(n - len(s), s.type)]) for s in state]
            yield pa.RecordBatch.from_arrays(padded, names=arrow.names)

    return run


def samples(df: DataFrame, n: int = SAMPLE_VALUES) -> DataFrame:
    """Up to ``n`` distinct non-null values per column as text, the smallest ones
    so that the result is the same on every run.

    One pass over the table: each task keeps its n smallest values per column; they are
    merged in ``MERGE_TASKS`` groups of tasks and then once. No column is shuffled and no
    unbounded set is built.
    """
    return _samples(df, n).select("column_name", "sample_values")


def _samples(df: DataFrame, n: int) -> DataFrame:
    # By position: Arrow UDFs do not take names with dots.
    flat = _flat(df)
    flat = flat.select(*[_one_zero(f.name, f.dataType).alias(f"c{i}") for i, f in enumerate(flat.schema.fields)])
    # Short lists are padded with NULLs, also in columns that have none.
    shape = T.StructType([T.StructField(f.name, f.dataType, True) for f in flat.schema.fields])
    few = flat.mapInArrow(_smallest(n), shape)

    def merged(values: Column) -> Column:
        return F.slice(F.array_sort(F.array_distinct(values)), 1, n)

    parts = few.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGE_TASKS)).alias("part")).agg(*[
        merged(F.collect_list(c)).alias(f"v{i}") for i, c in enumerate(flat.columns)])
    row = parts.agg(*[merged(F.flatten(F.collect_list(f"v{i}"))).cast("array<string>").alias(f"sample_values_{i}")
                      for i in range(len(flat.columns))])
    return _long(row, df, {"sample_values": "array<string>"})


def profile(df: DataFrame, table_name: str, sample_n: int = SAMPLE_VALUES,
            max_distinct_scan: int | None = None) -> DataFrame:
    """One row per column: type, row count, null ratio, distinct count, samples
    (``sample_n`` 0 leaves the samples out, ``max_distinct_scan`` as in
    ``distinct_counts``)."""
    return profile_tables({table_name: df}, None, sample_n, max_distinct_scan)


def profile_tables(tables: Mapping[str, DataFrame], only: Sequence[str] | None = None,
                   sample_n: int = SAMPLE_VALUES,
                   max_distinct_scan: int | None = None) -> DataFrame:
    """The profiles of several tables. The counts of all come from one job."""
    tables = {t: df for t, df in tables.items() if not only or t in only}
    counted = {t: df for t, df in tables.items() if max_distinct_scan is None or df.count() <= max_distinct_scan}
    stats = [_counts(counted)] if counted else []
    for t in tables.keys() - counted.keys():  # too large to count distinct values
        row = tables[t].agg(F.count("*").alias("row_count"), *_null_counts(tables[t]))
        kinds = F.array(*[F.lit(k) for _, k in tables[t].dtypes])
        stats.append(_long(row, tables[t], {"nulls": "bigint"}).select(
            F.lit(-1).alias("_id"), F.lit(t).alias("table_name"), "ordinal", "column_name",
            F.get(kinds, "ordinal").alias("data_type"), "row_count", "nulls",
            F.lit(-1).cast("bigint").alias("distinct_count")))
    out = reduce(DataFrame.unionByName, stats)
    kept = ["sample_values"] if sample_n else []
    if sample_n:
        shown = reduce(DataFrame.unionByName, [
            _samples(df, sample_n).select(F.lit(t).alias("table_name"), "ordinal", "sample_values")
            for t, df in tables.items()])
        out = out.join(shown, ["table_name", "ordinal"])
    return out.select("table_name", "ordinal", "column_name", "data_type", "row_count",
                      _null_ratio().alias("null_ratio"), "distinct_count", *kept)


def listed_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """What ``profile_entries`` needs of the tables: columns, types and row counts, which
    Parquet answers from its footers."""
    spark = next(iter(tables.values())).sparkSession
    counts = reduce(DataFrame.unionByName, [
        row_count(df).select(F.lit(t).alias("table_name"), "row_count") for t, df in tables.items()])
    return _columns(spark, tables).drop("_id").join(counts, "table_name")


def summarize(df: DataFrame) -> DataFrame:
    """``summarize_tables`` of one table, without its name."""
    return summarize_tables({"": df}).drop("table_name")


def summarize_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per column: min, max, approximate distinct, mean, deviation, exact quartiles (of
    numbers, as doubles), row count, null percentage.

    Defined cases: NaN is the largest number; an empty or non-numeric column has no
    quartiles; nested columns count as JSON text. One pass gives all but the quartiles,
    which ``exact_ranks`` finds. The driver sees one row per column.
    """
    rows = []
    for t, df in tables.items():
        flat = _flat(df)
        aggs: list[Column] = [F.count("*").alias("row_count"), *_null_counts(flat)]
        for i, f in enumerate(flat.schema.fields):
            c = F.col(f"`{f.name}`")
            number = c.cast("double") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")
            finite = F.when(F.abs(number) <= sys.float_info.max, number)
            aggs += [F.min(c).cast("string").alias(f"min_{i}"), F.max(c).cast("string").alias(f"max_{i}"),
                     F.approx_count_distinct(c).alias(f"approx_unique_{i}"),
                     F.avg(number).alias(f"avg_{i}"), F.stddev(number).alias(f"std_{i}"),
                     F.count(number).alias(f"numbers_{i}"),
                     F.min(finite).alias(f"low_{i}"), F.max(finite).alias(f"high_{i}")]
        parts = {"min": "string", "max": "string", "approx_unique": "bigint", "avg": "double", "std": "double",
                 "nulls": "bigint", "numbers": "bigint", "low": "double", "high": "double"}
        rows.append(_long(flat.agg(*aggs), df, parts).withColumn("table_name", F.lit(t)))
    stats = cut_lineage(reduce(DataFrame.unionByName, rows))
    number = {(t, i): n for n, (t, i, *_) in enumerate(_listing(tables))}
    wanted = {}
    for r in stats.filter("numbers > 0").collect():
        for name, numerator in (("q25", 1), ("q50", 2), ("q75", 3)):
            low = r.low if r.low is not None else 0.0
            wanted[number[r.table_name, r.ordinal], name] = (
                low, r.high if r.high is not None else 0.0, max(1, -(-r.numbers * numerator // 4)))
    found = exact_ranks(_cells(
        tables, lambda k: isinstance(k, T.NumericType),
        lambda f: [F.col(f"`{f.name}`").cast("double").alias("x")]), wanted) if wanted else {}
    names = ("q25", "q50", "q75")
    quartiles = stats.sparkSession.createDataFrame(
        [(t, i, *[found.get((number[t, i], q)) for q in names]) for t, i, *_ in _listing(tables)],
        "table_name string, ordinal int, q25 double, q50 double, q75 double")
    return stats.join(quartiles, ["table_name", "ordinal"]).select(
        "table_name", "ordinal", "column_name", "min", "max", "approx_unique", "avg", "std", *names, "row_count",
        (_null_ratio() * 100).alias("null_percentage"))


def exact_ranks(cells: DataFrame, wanted: Mapping[tuple[int, str], tuple[float, float, int]],
                buckets: int = RANK_BUCKETS, rest: int = RANK_REST) -> dict[tuple[int, str], float]:
    """Values at exact ranks, without a sort and in memory that does not grow with the rows.

    ``cells`` holds ``id`` and ``x`` (double); ``wanted`` says per (id, name) the smallest
    and largest finite number and the rank (from 1, NULLs left out, infinities and NaN at
    the ends). Each pass counts the values of a range in ``buckets`` equal parts and goes on
    with the part that holds the rank, between its own smallest and largest value, until
    that is one value or at most ``rest`` rows are left; these are counted by value. Every
    pass reads the cells once for all ranks, ranks in one range share its counts.
    """
    spark = cells.sparkSession
    cells = cells.filter("x IS NOT NULL")
    below = {k: 0 for k in wanted}  # rows before the range
    span = {k: (low, high) for k, (low, high, _) in wanted.items()}
    found: dict[tuple[int, str], float] = {}
    last = set()  # ranges with few rows
    first = True
    while span:
        ranges = sorted({(k[0], low, high, (k[0], low, high) in last) for k, (low, high) in span.items()})
        # At most as many rows as there are ranks to find.
        table = F.broadcast(spark.createDataFrame(
            [(*r, i) for i, r in enumerate(ranges)], "id int, low double, high double, few boolean, span int"))
        x, low, high = F.col("x") + 0.0, F.col("low"), F.col("high")
        rows = cells.join(table, "id")
        if not first:
            rows = rows.filter((x >= low) & (x <= high))
        share = F.try_divide(x / 2 - low / 2, high / 2 - low / 2)  # halves do not overflow
        part = (F.when(x < low, -1).when(F.isnan(x), buckets + 1).when(x > high, buckets)
                .otherwise(F.coalesce(F.least(F.floor(share * buckets), F.lit(buckets - 1)),
                                      F.when(x > low, 1).otherwise(0))).cast("int"))
        rows = rows.select("span", F.when(F.col("few"), F.lit(0)).otherwise(part).alias("part"),
                           F.when(F.col("few"), x).alias("value"), x.alias("x"))
        counts = rows.groupBy("span", "part", "value").agg(
            F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
        order = Window.partitionBy("span").orderBy("part", "value")
        counts = cut_lineage(counts.withColumn("upto", F.sum("n").over(order)))
        place = {(i, low, high): n for n, (i, low, high, _) in enumerate(ranges)}
        goals = spark.createDataFrame(
            [(place[k[0], *span[k]], k[0], k[1], wanted[k][2] - below[k]) for k in span],
            "span int, id int, name string, goal bigint")
        hits = counts.join(F.broadcast(goals), "span").filter(
            (F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("n") < F.col("goal"))).collect()
        last, span = set(), {}
        for r in hits:
            key = r.id, r.name
            below[key] += r.upto - r.n
            if r.a == r.b or r.a != r.a:
                found[key] = r.a
            else:
                span[key] = r.a, r.b
                if r.n <= rest:
                    last.add((r.id, r.a, r.b))
        first = False
    return found


def profile_entries(profiles: DataFrame) -> DataFrame:
    """Context entries from profiles: one ``table_note`` per table that lists its
    columns, tagged with the table and column names."""
    column = F.struct("ordinal", "column_name", "data_type")
    grouped = profiles.groupBy("table_name").agg(
        F.first("row_count").alias("row_count"),
        F.array_sort(F.collect_list(column)).alias("_cols"))
    names = F.transform("_cols", lambda c: c["column_name"])
    listing = F.array_join(F.transform(
        "_cols", lambda c: F.concat(c["column_name"], F.lit(" ("), c["data_type"], F.lit(")"))), ", ")
    return grouped.select(
        F.concat(F.lit("profile."), "table_name").alias("id"),
        F.lit("table_note").alias("kind"),
        F.concat(F.lit("Columns of table "), "table_name").alias("title"),
        F.concat(F.col("row_count").cast("string"), F.lit(" rows. Columns: "), listing).alias("text"),
        F.concat(F.array("table_name"), names).alias("tags"),
        F.array("table_name").alias("tables"),
    )
