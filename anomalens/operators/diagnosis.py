"""Where did a measure move? Period sums, drill-down, change, contribution.

Measures are sums over a fact table. Everything below is conditional aggregation
with map-side partial sums, so a member that owns most of the rows costs no more
than any other, and period filters on date columns are written as ranges that
reach the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F, types as T

from anomalens.plans.skew import rank_within
from anomalens.plans.storage import cut_lineage

_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_temporal(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, _TEMPORAL)


def month_of(df: DataFrame, column: str) -> Column:
    """``yyyy-MM`` bucket, chosen by the type of the column."""
    if is_temporal(df, column):
        return F.date_format(column, "yyyy-MM")
    return F.substring(F.col(column), 1, 7)


def _bounds(month: str) -> tuple[date, date]:
    year, number = (int(x) for x in month.split("-"))
    return date(year, number, 1), date(year + number // 12, number % 12 + 1, 1)


def in_months(df: DataFrame, column: str, months: Sequence[str]) -> Column:
    """Rows of the given months, as range predicates (adjacent months merged), because
    a formatted date or a substring would not reach the scan."""
    kind = df.schema[column].dataType
    # ISO texts order like their dates, and so do prefixes of them.
    text = not is_temporal(df, column)
    spans: list[list[date]] = []
    for low, high in sorted({_bounds(m) for m in months}):
        if spans and spans[-1][1] == low:
            spans[-1][1] = high
        else:
            spans.append([low, high])
    out = F.lit(False)
    for low, high in spans:
        low, high = (F.lit(f"{d:%Y-%m}") if text else F.lit(d).cast(kind) for d in (low, high))
        rng = (F.col(column) >= low) & (F.col(column) < high)
        out = rng if len(spans) == 1 else out | rng
    return out


def in_month(df: DataFrame, column: str, month: str) -> Column:
    return in_months(df, column, [month])


def _sums(measures: Mapping[str, Column]) -> list[Column]:
    return [F.sum(c).alias(name) for name, c in measures.items()]


def metric(name: str, gross: str = "gmv", refund: str = "refund_amount",
           new_flag: str = "is_new_customer") -> Column:
    """Row-level expression of a named metric; the metric is its sum.

    ``gmv`` includes refunded orders, ``net_gmv`` subtracts refunds,
    ``new_customer_gmv`` counts orders flagged as first orders.
    """
    return {
        "gmv": F.col(gross),
        "net_gmv": F.col(gross) - F.col(refund),
        "new_customer_gmv": F.when(F.col(new_flag) == 1, F.col(gross)).otherwise(F.lit(0.0)),
    }[name]


def totals(df: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    """Global row count and sums."""
    return df.agg(F.count("*").alias("row_count"), *_sums(measures))


def period_trend(df: DataFrame, dimension: str, date_column: str,
                 measures: Mapping[str, Column], months: Sequence[str] | None = None) -> DataFrame:
    """Sums by dimension and month, ordered."""
    if months:
        df = df.filter(in_months(df, date_column, months))
    return (df.groupBy(dimension, month_of(df, date_column).alias("month"))
            .agg(*_sums(measures)).orderBy(dimension, "month"))


def drill_down(df: DataFrame, dimension: str, measures: Mapping[str, Column],
               where: Mapping[str, object] | None = None,
               date_column: str | None = None, month: str | None = None) -> DataFrame:
    """Sums by one dimension inside a slice, largest first."""
    df = _slice(df, where, date_column, [month] if month else None)
    first = next(iter(measures))
    return (df.groupBy(dimension).agg(*_sums(measures))
            .orderBy(F.desc(first), F.asc(dimension)))


def slice_series(df: DataFrame, date_column: str, measures: Mapping[str, Column],
                 where: Mapping[str, object] | None = None,
                 months: Sequence[str] | None = None) -> DataFrame:
    """Sums by month inside a slice, ordered."""
    df = _slice(df, where, date_column, months)
    return (df.groupBy(month_of(df, date_column).alias("month"))
            .agg(*_sums(measures)).orderBy("month"))


def scalar_sum(df: DataFrame, measure: Column, where: Mapping[str, object] | None = None,
               date_column: str | None = None, month: str | None = None,
               out: str = "value") -> DataFrame:
    """One row with the sum over a slice; NULL if the slice is empty."""
    return _slice(df, where, date_column, [month] if month else None).agg(F.sum(measure).alias(out))


def exclusion_breakdown(df: DataFrame, dimension: str, member: object,
                        measures: Mapping[str, Column],
                        where: Mapping[str, object] | None = None,
                        date_column: str | None = None, month: str | None = None) -> DataFrame:
    """Sums of all members other than the given one."""
    df = _slice(df, where, date_column, [month] if month else None)
    return df.filter(F.col(dimension) != F.lit(member)).groupBy(dimension).agg(*_sums(measures))


def _slice(df: DataFrame, where: Mapping[str, object] | None,
           date_column: str | None, months: Sequence[str] | None) -> DataFrame:
    for name, value in (where or {}).items():
        df = df.filter(F.col(name) == F.lit(value))
    return df.filter(in_months(df, date_column, months)) if months else df


def change(base: Column, current: Column, null_base: bool = False) -> Column:
    """Relative change; base 0 or NULL gives 0.0 (NULL with ``null_base``), a
    missing current value counts as 0."""
    out = F.try_divide(F.coalesce(current, F.lit(0.0)) - base, base)
    return out if null_base else F.coalesce(out, F.lit(0.0))


def contribution(delta: Column, total_delta: Column) -> Column:
    """Share of a slice in the change of the total; no change gives 0.0."""
    return F.coalesce(F.try_divide(delta, total_delta), F.lit(0.0))


def two_periods(df: DataFrame, date_column: str, measure: Column,
                base: str, current: str) -> tuple[DataFrame, list[Column]]:
    """The rows of both periods and the two conditional sums, in one scan."""
    both = df.filter(in_months(df, date_column, [base, current]))
    sums = [F.sum(F.when(in_month(df, date_column, m), measure)).alias(n)
            for n, m in (("base_value", base), ("current_value", current))]
    return both, sums


def period_change(df: DataFrame, dimension: str, date_column: str, measure: Column,
                  base: str, current: str) -> DataFrame:
    """Base, current and relative change of every member of one dimension."""
    both, sums = two_periods(df, date_column, measure, base, current)
    return both.groupBy(dimension).agg(*sums).withColumn(
        "change", change(F.col("base_value"), F.col("current_value")))


def member_contribution(df: DataFrame, dimension: str, date_column: str, measure: Column,
                        base: str, current: str) -> DataFrame:
    """``period_change`` plus each member's share in the change of the total."""
    members = attribution(df, [dimension], date_column, measure, base, current, ranked=False)
    return members.drop("dimension").withColumnRenamed("member", dimension)


def slice_metrics(df: DataFrame, date_column: str, measure: Column, base: str, current: str,
                  outer: Mapping[str, object], inner: Mapping[str, object]) -> DataFrame:
    """One row: change of an outer slice, change of a slice inside it, and the
    inner slice's contribution. A single conditional aggregation instead of one
    subquery per number; an empty or zero base gives NULL."""
    both, _ = two_periods(df, date_column, measure, base, current)
    for name, value in outer.items():
        both = both.filter(F.col(name) == F.lit(value))
    inside = F.lit(True)
    for name, value in inner.items():
        inside = inside & (F.col(name) == F.lit(value))
    at = {m: in_month(df, date_column, m) for m in (base, current)}
    row = both.agg(
        F.sum(F.when(at[base], measure)).alias("ob"),
        F.sum(F.when(at[current], measure)).alias("oc"),
        F.sum(F.when(at[base] & inside, measure)).alias("ib"),
        F.sum(F.when(at[current] & inside, measure)).alias("ic"),
    )
    return row.select(
        (F.try_divide("oc", "ob") - 1).alias("outer_change"),
        (F.try_divide("ic", "ib") - 1).alias("inner_change"),
        F.try_divide(F.col("ic") - F.col("ib"), F.col("oc") - F.col("ob")).alias("inner_contribution"),
    )


def attribution(df: DataFrame, dimensions: Sequence[str], date_column: str, measure: Column,
                base: str, current: str, ranked: bool = True) -> DataFrame:
    """Every member of every candidate dimension with base, current, change,
    contribution to the change of the total, and rank within its dimension."""
    rows = df.filter(in_months(df, date_column, [base, current])).select(
        *[F.col(d).alias(f"d{i}") for i, d in enumerate(dimensions)],
        *[F.when(in_month(df, date_column, m), measure).alias(n)
          for n, m in (("base_value", base), ("current_value", current))])
    return members_of(rows, {d: f"d{i}" for i, d in enumerate(dimensions)}, ranked)


def members_of(summed: DataFrame, dimensions: Mapping[str, str], ranked: bool = True) -> DataFrame:
    """``attribution`` over rows that already carry ``base_value`` and
    ``current_value``; ``dimensions`` maps the reported name to the column.

    Grouping sets: each task sums its rows to the members of each dimension, so the
    shuffle carries members, also where the dimensions have many combinations.
    """
    names, columns = list(dimensions), [f"m{i}" for i in range(len(dimensions))]
    cells = summed.select(*[F.col(c).cast("string").alias(m) for m, c in zip(columns, dimensions.values())],
                          "base_value", "current_value")
    # Bit i of the grouping id, from the left, is 0 in the set of dimension i.
    every = (1 << len(names)) - 1
    sets = {every - (1 << (len(names) - 1 - i)): i for i in range(len(names))}
    members = (cells.groupingSets([[m] for m in columns], *columns)
               .agg(F.sum("base_value").alias("base_value"), F.sum("current_value").alias("current_value"),
                    F.grouping_id().alias("of"))
               .select(F.create_map(*[x for k, i in sets.items() for x in (F.lit(k).cast("bigint"), F.lit(names[i]))])[F.col("of")]
                       .alias("dimension"), F.coalesce(*columns).alias("member"), "base_value", "current_value"))
    if ranked:
        # The facts are read once; ranking goes on from the written members.
        members = cut_lineage(members)
    zero = F.lit(0.0)
    b, c = F.coalesce("base_value", zero), F.coalesce("current_value", zero)
    # Every dimension splits the same total, so the members of any one of them add
    # up to it; the scalar reads the finished members, not the facts again.
    total = (members.filter(F.col("dimension") == next(iter(dimensions)))
             .agg(F.sum(c - b).alias("t")).scalar())
    out = members.select(
        "dimension", "member", b.alias("base_value"), c.alias("current_value"),
        change(F.col("base_value"), F.col("current_value")).alias("change"),
        contribution(c - b, total).alias("contribution"),
    )
    return rank_within(out, "dimension", "contribution", "member", "rank") if ranked else out


def by_attribute(fact: DataFrame, dim: DataFrame, key: str, attribute: str,
                 measures: Mapping[str, Column], how: str = "inner") -> DataFrame:
    """Sums of a fact table by an attribute of a joined table, largest first.

    The fact is summed per key before the join: the shuffle carries one partial
    row per key and task, and a key that owns a third of the fact is one row by
    the time it meets the other side.
    """
    per_key = fact.groupBy(key).agg(*_sums(measures))
    joined = per_key.join(dim.select(key, attribute), key, how)
    first = next(iter(measures))
    return (joined.groupBy(attribute).agg(*[F.sum(n).alias(n) for n in measures])
            .orderBy(F.desc(first), F.asc(attribute)))


def ground_truth(df: DataFrame, dimension: str, date_column: str, measure: Column,
                 within: str | None = None) -> DataFrame:
    """Task rows whose key numbers are computed from the data: one per member of
    ``dimension`` and month that has a previous month, with the member's change,
    the change of the total and the member's contribution (rounded to 6).

    ``within`` makes the totals those of another dimension's members. A member that
    is missing in one of the two months counts as 0 there: one that vanished or is
    new has a task like any other, and so has the NULL member. One scan: every monthly
    sum serves as current value of its month and as base of the next.
    """
    keys = [within] if within else []
    monthly = df.groupBy(*keys, dimension, month_of(df, date_column).alias("month")).agg(
        F.sum(measure).alias("value"))
    next_month = F.date_format(F.add_months(F.to_date("month", "yyyy-MM"), 1), "yyyy-MM")
    nothing = F.lit(None).cast("double")
    value = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    roles = monthly.select(*keys, dimension, F.explode(F.array(
        F.struct(F.col("month"), value.alias("value"), nothing.alias("base_value")),
        F.struct(next_month.alias("month"), nothing.alias("value"), value.alias("base_value")))).alias("r"))
    both = roles.groupBy(*keys, dimension, "r.month").agg(
        F.sum("r.value").alias("value"), F.sum("r.base_value").alias("base_value"))
    # Members of one month; they combine map-side.
    overall = both.groupBy(*[F.col(k).alias("_k") for k in keys], F.col("month").alias("_m")).agg(
        F.sum("value").alias("total"), F.sum("base_value").alias("base_total"))
    same = F.col("month") == F.col("_m")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_k"))
    paired = both.join(overall.filter("total IS NOT NULL AND base_total IS NOT NULL"), same)
    paired = paired.fillna(0.0, ["value", "base_value"])
    member = F.coalesce(F.col(dimension).cast("string"), F.lit("NULL"))
    scope = F.concat(F.coalesce(F.col(within).cast("string"), F.lit("NULL")), F.lit("/")) if within else F.lit("")
    fragment = F.when(F.col(dimension).isNull(), F.lit(f"{dimension} IS NULL")).otherwise(
        F.concat(F.lit(f"{dimension}='"), member, F.lit("'")))
    numbers = F.create_map(
        F.lit("total_change"), F.round(change(F.col("base_total"), F.col("total")), 6),
        F.lit("member_change"), F.round(change(F.col("base_value"), F.col("value")), 6),
        F.lit("contribution"), F.round(contribution(
            F.col("value") - F.col("base_value"), F.col("total") - F.col("base_total")), 6),
    )
    return paired.select(
        F.concat(F.lit(f"{dimension}="), scope, member, F.lit("@"), F.col("month")).alias("task_id"),
        F.concat(F.lit("Why did the measure move in "), F.col("month"), F.lit(" against the month "
                 "before, and how much of it is due to "), scope, member, F.lit("?")).alias("question"),
        F.struct(
            F.col(dimension).cast("string").alias("root_cause_dimension"),
            numbers.alias("key_numbers"),
            F.array(fragment).alias("expected_sql_fragments"),
        ).alias("reference"),
        F.to_variant_object(F.struct(
            F.col("base_value"), F.col("value").alias("current_value"),
            F.col("base_total"), F.col("total").alias("current_total"),
        )).alias("meta"),
    )
