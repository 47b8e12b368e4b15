"""Diagnosis analytics on orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from anomalens.operators import diagnosis as D
from anomalens.operators.results import capped, limited
from workload.tables import table

BASE, CURRENT = "1997-02", "1997-03"
URGENT = "1-URGENT"


def _price() -> dict:
    return {"revenue": F.col("o_totalprice")}


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders")


def _sales(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem in the shape of a sales fact: gross, refund, first-line flag."""
    return table(spark, sf, "lineitem").select(
        "l_partkey", "l_returnflag", "l_shipdate",
        F.col("l_extendedprice").alias("gmv"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("refund_amount"),
        F.when(F.col("l_linenumber") == 1, 1).otherwise(0).alias("is_new_customer"),
    )


def attribution_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Which region, segment, priority or status explains the change of revenue?

    Orders are summed per customer (and the order-level dimensions) before the
    join, so neither the join nor its shuffle sees a hot customer's rows.
    """
    orders = _orders(spark, sf)
    both, sums = D.two_periods(orders, "o_orderdate", F.col("o_totalprice"), BASE, CURRENT)
    per_customer = both.groupBy("o_custkey", "o_orderpriority", "o_orderstatus").agg(*sums)
    places = (table(spark, sf, "nation")
              .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
              .select("n_nationkey", "r_name"))
    customers = (table(spark, sf, "customer")
                 .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
                 .select("c_custkey", "c_mktsegment", "r_name"))
    wide = per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return D.members_of(wide, {"region": "r_name", "segment": "c_mktsegment",
                               "priority": "o_orderpriority", "status": "o_orderstatus"})


_ATTRIBUTION_SQL = f"""
WITH wide AS (
  SELECT r_name, c_mktsegment, o_orderpriority, o_orderstatus,
         CASE WHEN strftime(o_orderdate, '%Y-%m') = '{BASE}' THEN o_totalprice END AS b,
         CASE WHEN strftime(o_orderdate, '%Y-%m') = '{CURRENT}' THEN o_totalprice END AS c
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
  WHERE strftime(o_orderdate, '%Y-%m') IN ('{BASE}', '{CURRENT}')
), m AS (
  SELECT CASE WHEN grouping(r_name) = 0 THEN 'region' WHEN grouping(c_mktsegment) = 0 THEN 'segment'
              WHEN grouping(o_orderpriority) = 0 THEN 'priority' ELSE 'status' END AS dimension,
         coalesce(r_name, c_mktsegment, o_orderpriority, o_orderstatus) AS member,
         coalesce(sum(b), 0) AS base_value, coalesce(sum(c), 0) AS current_value
  FROM wide
  GROUP BY GROUPING SETS ((r_name), (c_mktsegment), (o_orderpriority), (o_orderstatus))
), d AS (
  SELECT *, CASE WHEN base_value = 0 THEN 0.0 ELSE (current_value - base_value) / base_value END AS change,
    (current_value - base_value)
      / (SELECT coalesce(sum(c), 0) - coalesce(sum(b), 0) FROM wide) AS contribution FROM m
)
SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY contribution DESC, member) AS rank FROM d
"""

_MONTHS = f"('{BASE}', '{CURRENT}')"
_M = "strftime(o_orderdate, '%Y-%m')"
_LM = "strftime(l_shipdate, '%Y-%m')"


def month_bucket(spark: SparkSession, sf: str) -> DataFrame:
    """The bucket of a date column and of its text form must agree."""
    o = _orders(spark, sf).withColumn("as_text", F.col("o_orderdate").cast("string"))
    return (o.groupBy(D.month_of(o, "o_orderdate").alias("month"),
                      D.month_of(o, "as_text").alias("text_month"))
            .agg(F.count("*").alias("n")))


def named_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return D.drill_down(_sales(spark, sf), "l_returnflag",
                        {m: D.metric(m) for m in ("gmv", "net_gmv", "new_customer_gmv")})


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    t = D.ground_truth(_orders(spark, sf), "o_orderpriority", "o_orderdate",
                       F.col("o_totalprice"), within="o_orderstatus")
    n = F.col("reference.key_numbers")
    return t.select(
        "task_id", F.col("reference.root_cause_dimension").alias("root_cause_dimension"),
        n["total_change"].alias("total_change"), n["member_change"].alias("member_change"),
        n["contribution"].alias("contribution"),
        F.expr("variant_get(meta, '$.base_value', 'double')").alias("base_value"),
    )


QUERIES = {
    "C1_month_bucket": month_bucket,
    "C2_period_trend": lambda s, d: D.period_trend(
        _orders(s, d), "o_orderpriority", "o_orderdate", _price()),
    "C3_period_in_list": lambda s, d: D.period_trend(
        _orders(s, d), "o_orderpriority", "o_orderdate", _price(), [BASE, CURRENT]),
    "C4_drill_down": lambda s, d: D.drill_down(
        _orders(s, d), "o_orderpriority", _price(), {"o_orderstatus": "O"}, "o_orderdate", CURRENT),
    "C5_channel_split": lambda s, d: D.drill_down(
        _orders(s, d), "o_orderstatus", _price(), {"o_orderpriority": URGENT}, "o_orderdate", CURRENT),
    "C6_slice_series": lambda s, d: D.slice_series(
        _orders(s, d), "o_orderdate", _price(),
        {"o_orderstatus": "O", "o_orderpriority": URGENT}, [BASE, CURRENT]),
    "C7_scalar_sum": lambda s, d: D.scalar_sum(
        _orders(s, d), F.col("o_totalprice"), {"o_orderpriority": URGENT}, "o_orderdate", CURRENT,
        out="revenue"),
    "C8_exclusion_breakdown": lambda s, d: D.exclusion_breakdown(
        _orders(s, d), "o_orderpriority", URGENT, _price(), {"o_orderstatus": "O"},
        "o_orderdate", CURRENT),
    "C9_period_change": lambda s, d: D.period_change(
        _orders(s, d), "o_orderpriority", "o_orderdate", F.col("o_totalprice"), BASE, CURRENT),
    "C10_contribution": lambda s, d: D.member_contribution(
        _orders(s, d), "o_orderpriority", "o_orderdate", F.col("o_totalprice"), BASE, CURRENT),
    "C11_slice_metrics": lambda s, d: D.slice_metrics(
        _orders(s, d), "o_orderdate", F.col("o_totalprice"), BASE, CURRENT,
        {"o_orderstatus": "O"}, {"o_orderpriority": URGENT}),
    "C12_attribution_scan": attribution_scan,
    "C13_named_metrics": named_metrics,
    "C14_by_customer_segment": lambda s, d: D.by_attribute(
        _orders(s, d).withColumnRenamed("o_custkey", "c_custkey"), table(s, d, "customer"),
        "c_custkey", "c_mktsegment", _price()),
    "C15_by_product_brand": lambda s, d: D.by_attribute(
        _sales(s, d).withColumnRenamed("l_partkey", "p_partkey"), table(s, d, "part"),
        "p_partkey", "p_brand", {"net_gmv": D.metric("net_gmv"), "line_count": F.lit(1)}),
    "C16_totals": lambda s, d: D.totals(_orders(s, d), _price()),
    "C17_capped_result": lambda s, d: capped(
        _orders(s, d).select("o_orderkey", "o_totalprice").orderBy("o_orderkey")).select(
            F.inline(F.transform("rows", lambda r: F.struct(
                r[0].alias("o_orderkey"), r[1].cast("double").alias("o_totalprice")))),
            "row_count", "truncated"),
    "C18_limit": lambda s, d: limited(
        D.drill_down(_orders(s, d), "o_custkey", _price()), 10),
    "C19_ground_truth_tasks": tasks,
}

ORACLES = {
    "C1_month_bucket": f"""
SELECT {_M} AS month, substr(CAST(o_orderdate AS VARCHAR), 1, 7) AS text_month, count(*) AS n
FROM orders GROUP BY 1, 2""",
    "C2_period_trend": f"""
SELECT o_orderpriority, {_M} AS month, sum(o_totalprice) AS revenue FROM orders GROUP BY 1, 2""",
    "C3_period_in_list": f"""
SELECT o_orderpriority, {_M} AS month, sum(o_totalprice) AS revenue FROM orders
WHERE {_M} IN {_MONTHS} GROUP BY 1, 2""",
    "C4_drill_down": f"""
SELECT o_orderpriority, sum(o_totalprice) AS revenue FROM orders
WHERE o_orderstatus = 'O' AND {_M} = '{CURRENT}' GROUP BY 1""",
    "C5_channel_split": f"""
SELECT o_orderstatus, sum(o_totalprice) AS revenue FROM orders
WHERE o_orderpriority = '{URGENT}' AND {_M} = '{CURRENT}' GROUP BY 1""",
    "C6_slice_series": f"""
SELECT {_M} AS month, sum(o_totalprice) AS revenue FROM orders
WHERE o_orderstatus = 'O' AND o_orderpriority = '{URGENT}' AND {_M} IN {_MONTHS} GROUP BY 1""",
    "C7_scalar_sum": f"""
SELECT sum(o_totalprice) AS revenue FROM orders
WHERE o_orderpriority = '{URGENT}' AND {_M} = '{CURRENT}'""",
    "C8_exclusion_breakdown": f"""
SELECT o_orderpriority, sum(o_totalprice) AS revenue FROM orders
WHERE o_orderstatus = 'O' AND {_M} = '{CURRENT}' AND o_orderpriority <> '{URGENT}' GROUP BY 1""",
    "C9_period_change": f"""
WITH p AS (SELECT o_orderpriority,
  sum(CASE WHEN {_M} = '{BASE}' THEN o_totalprice END) AS base_value,
  sum(CASE WHEN {_M} = '{CURRENT}' THEN o_totalprice END) AS current_value
  FROM orders WHERE {_M} IN {_MONTHS} GROUP BY 1)
SELECT *, coalesce((coalesce(current_value, 0) - base_value) / nullif(base_value, 0), 0) AS change FROM p""",
    "C10_contribution": f"""
WITH p AS (SELECT o_orderpriority,
  coalesce(sum(CASE WHEN {_M} = '{BASE}' THEN o_totalprice END), 0) AS base_value,
  coalesce(sum(CASE WHEN {_M} = '{CURRENT}' THEN o_totalprice END), 0) AS current_value
  FROM orders WHERE {_M} IN {_MONTHS} GROUP BY 1)
SELECT *, coalesce((current_value - base_value) / nullif(base_value, 0), 0) AS change,
  (current_value - base_value) / (sum(current_value - base_value) OVER ()) AS contribution FROM p""",
    "C11_slice_metrics": f"""
WITH o AS (SELECT {_M} AS m, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
i AS (SELECT {_M} AS m, sum(o_totalprice) AS v FROM orders
      WHERE o_orderstatus = 'O' AND o_orderpriority = '{URGENT}' GROUP BY 1)
SELECT (SELECT v FROM o WHERE m = '{CURRENT}') / (SELECT v FROM o WHERE m = '{BASE}') - 1 AS outer_change,
  (SELECT v FROM i WHERE m = '{CURRENT}') / (SELECT v FROM i WHERE m = '{BASE}') - 1 AS inner_change,
  ((SELECT v FROM i WHERE m = '{CURRENT}') - (SELECT v FROM i WHERE m = '{BASE}'))
  / ((SELECT v FROM o WHERE m = '{CURRENT}') - (SELECT v FROM o WHERE m = '{BASE}')) AS inner_contribution""",
    "C12_attribution_scan": _ATTRIBUTION_SQL,
    "C13_named_metrics": """
SELECT l_returnflag, sum(l_extendedprice) AS gmv,
  sum(l_extendedprice) - sum(l_extendedprice * l_discount) AS net_gmv,
  sum(CASE WHEN l_linenumber = 1 THEN l_extendedprice ELSE 0 END) AS new_customer_gmv
FROM lineitem GROUP BY 1""",
    "C14_by_customer_segment": """
SELECT c_mktsegment, sum(o_totalprice) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "C15_by_product_brand": """
SELECT p_brand, sum(l_extendedprice - l_extendedprice * l_discount) AS net_gmv, count(*) AS line_count
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
    "C16_totals": "SELECT count(*) AS row_count, sum(o_totalprice) AS revenue FROM orders",
    "C17_capped_result": """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_totalprice,
  CAST(least(50, (SELECT count(*) FROM orders)) AS BIGINT) AS row_count,
  (SELECT count(*) FROM orders) > 50 AS truncated
FROM orders ORDER BY orders.o_orderkey LIMIT 50""",
    "C18_limit": """
SELECT o_custkey, sum(o_totalprice) AS revenue FROM orders GROUP BY 1
ORDER BY revenue DESC, o_custkey LIMIT 10""",
    "C19_ground_truth_tasks": """
WITH v AS (SELECT o_orderstatus, o_orderpriority, date_trunc('month', o_orderdate) AS mt,
             sum(o_totalprice) AS value FROM orders GROUP BY ALL),
t AS (SELECT o_orderstatus, mt, sum(value) AS total FROM v GROUP BY ALL),
p AS (SELECT c.*, b.total AS base_total FROM t c JOIN t b ON c.o_orderstatus = b.o_orderstatus AND b.mt = c.mt - INTERVAL 1 MONTH),
m AS (SELECT DISTINCT o_orderstatus, o_orderpriority, mt FROM v
      UNION SELECT o_orderstatus, o_orderpriority, CAST(mt + INTERVAL 1 MONTH AS DATE) FROM v),
b AS (SELECT m.*, strftime(m.mt, '%Y-%m') AS month, p.total, p.base_total, coalesce(c.value, 0) AS value,
        coalesce(a.value, 0) AS base_value
  FROM m JOIN p ON m.o_orderstatus = p.o_orderstatus AND m.mt = p.mt
  LEFT JOIN v c ON m.o_orderstatus = c.o_orderstatus AND m.o_orderpriority IS NOT DISTINCT FROM c.o_orderpriority AND c.mt = m.mt
  LEFT JOIN v a ON m.o_orderstatus = a.o_orderstatus AND m.o_orderpriority IS NOT DISTINCT FROM a.o_orderpriority AND a.mt = m.mt - INTERVAL 1 MONTH)
SELECT 'o_orderpriority=' || o_orderstatus || '/' || o_orderpriority || '@' || month AS task_id,
  o_orderpriority AS root_cause_dimension, round((total - base_total) / base_total, 6) AS total_change,
  coalesce(round((value - base_value) / nullif(base_value, 0), 6), 0) AS member_change,
  coalesce(round((value - base_value) / nullif(total - base_total, 0), 6), 0) AS contribution, base_value FROM b""",
}
