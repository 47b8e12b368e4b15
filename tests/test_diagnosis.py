import pytest
from pyspark.sql import functions as F

from anomalens.operators import diagnosis as D
from anomalens.operators.results import capped
from anomalens.plans import skew

GMV = {"gmv": F.col}

def gmv():
    return {"gmv": F.col("gmv")}

def test_month_bucket_of_dates_and_texts(sales):
    for df in (sales, sales.withColumn("order_date", F.col("order_date").cast("string"))):
        got = D.period_trend(df, "region", "order_date", gmv(), ["2026-02", "2026-03"]).collect()
        assert [tuple(r) for r in got] == [
            ("north", "2026-02", 400.0), ("north", "2026-03", 360.0), ("south", "2026-03", 200.0)]

def test_month_filter_is_a_range_over_the_year_end(sales):
    text = str(D.in_months(sales, "order_date", ["2026-12", "2027-01"]))
    assert "2026-12-01" in text and "2027-02-01" in text and "date_format" not in text

def test_drill_down_and_scalars(sales):
    got = D.drill_down(sales, "category", gmv(), {"region": "north"}, "order_date", "2026-03").collect()
    assert [tuple(r) for r in got] == [("rice", 270.0), ("tea", 90.0)]
    where = {"region": "north"}
    assert D.scalar_sum(sales, F.col("gmv"), where, "order_date", "2026-02").first().value == 400.0
    assert D.scalar_sum(sales, F.col("gmv"), {"region": "west"}, "order_date", "2026-02").first().value is None
    other = D.exclusion_breakdown(sales, "category", "tea", gmv(), where, "order_date", "2026-03").collect()
    assert [tuple(r) for r in other] == [("rice", 270.0)]

def test_slice_metrics(sales):
    m = D.slice_metrics(sales, "order_date", F.col("gmv"), "2026-02", "2026-03", {"region": "north"}, {"category": "tea"}).first()
    assert tuple(m) == pytest.approx((-0.10, -0.25, 0.75), abs=1e-6)
    none = D.slice_metrics(sales, "order_date", F.col("gmv"), "2026-02", "2026-03", {"region": "west"}, {"category": "tea"}).first()
    assert tuple(none) == (None, None, None)

def test_attribution(sales):
    rows = {(r.dimension, r.member): r for r in D.attribution(
        sales, ["region", "category"], "order_date", F.col("gmv"), "2026-02", "2026-03").collect()}
    # 400 -> 560 in total; a member without a base has change 0
    assert rows["region", "south"].contribution == pytest.approx(200 / 160) and rows["region", "south"].change == 0.0
    assert rows["region", "north"].contribution == pytest.approx(-40 / 160) and rows["region", "north"].rank == 2
    assert rows["category", "tea"].rank == 1

def test_no_change_means_no_contribution(spark):
    df = spark.createDataFrame([("a", "2026-01-01", 5.0), ("a", "2026-02-01", 5.0)], "d string, t string, v double")
    r = D.attribution(df, ["d"], "t", F.col("v"), "2026-01", "2026-02").first()
    assert (r.change, r.contribution) == (0.0, 0.0)

def test_rank_spread_equals_window(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "small").otherwise("big").alias("g"),
        F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("v"), F.col("id").cast("string").alias("m"))
    spread = skew._rank_spread(df, "g", "v", "m", "r")
    plain = skew.rank_within(df, "g", "v", "m", "r")
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, plain.collect()))

def test_join_unique_with_a_hot_key(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 2500).cast("string"))).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s")).filter("k <> 'k7'")
    got = skew.join_unique(rows, table, "k", "n")
    want = rows.join(table.drop("n"), "k")
    assert sorted(map(tuple, got.select("k", "id", "s").collect())) == sorted(map(tuple, want.select("k", "id", "s").collect()))

def test_by_attribute_sums_before_the_join(sales, spark):
    dim = spark.createDataFrame([(11, "x"), (12, "x"), (13, "y")], "order_id int, brand string")
    got = D.by_attribute(sales, dim, "order_id", "brand", gmv())
    assert [tuple(r) for r in got.collect()] == [("x", 400.0), ("y", 90.0)]
    left = D.by_attribute(sales, dim, "order_id", "brand", gmv(), how="left").collect()
    assert (None, 470.0) in [tuple(r) for r in left]

def test_ground_truth(sales):
    t = D.ground_truth(sales.filter("region = 'north'"), "category", "order_date", F.col("gmv"), within="region").collect()
    numbers = {r.task_id: r.reference.key_numbers for r in t}
    assert numbers["category=north/tea@2026-03"] == {"total_change": -0.1, "member_change": -0.25, "contribution": 0.75}

def test_ground_truth_keeps_vanished_new_and_null_members(spark):
    rows = [("gone", "2026-01-05", 60.0), ("stays", "2026-01-06", 40.0), (None, "2026-01-07", 100.0),
            ("stays", "2026-02-06", 50.0), (None, "2026-02-08", 90.0), ("new", "2026-02-09", 10.0),
            ("late", "2026-05-01", 1.0)]
    df = spark.createDataFrame(rows, "who string, day string, v double")
    t = {r.task_id: r.reference for r in D.ground_truth(df, "who", "day", F.col("v")).drop("meta").collect()}
    assert set(t) == {f"who={m}@2026-02" for m in ("gone", "stays", "NULL", "new")}  # May has no month before
    assert t["who=gone@2026-02"].key_numbers == {"total_change": -0.25, "member_change": -1.0, "contribution": 1.2}
    assert t["who=new@2026-02"].key_numbers == {"total_change": -0.25, "member_change": 0.0, "contribution": -0.2}
    assert t["who=NULL@2026-02"].expected_sql_fragments == ["who IS NULL"]

def test_month_filter_on_texts_is_a_range(sales):
    df = sales.withColumn("order_date", F.col("order_date").cast("string"))
    text = str(D.in_months(df, "order_date", ["2026-12", "2027-01"]))
    assert "2026-12" in text and "2027-02" in text and "substring" not in text
    assert df.filter(D.in_month(df, "order_date", "2026-02")).count() == 2

def test_capped_result(sales):
    r = capped(sales, 3).first()
    assert (r.row_count, r.truncated, len(r.rows), r.columns[0]) == (3, True, 3, "order_id")
    r = capped(sales.limit(2), 3).first()
    assert (r.row_count, r.truncated) == (2, False)
    assert capped(sales.filter("false"), 3).first().row_count == 0

def test_attribution_shuffles_members_not_combinations(spark):
    # 4000 rows, as many combinations of two dimensions, 200 members in each.
    rows = spark.range(4000, numPartitions=1).select(
        (F.col("id") % 200).alias("a"), F.when(F.col("id") >= 20, F.floor(F.col("id") / 20)).alias("b"),
        F.lit("2026-01-05").alias("t"), F.lit(1.0).alias("v"))
    found = D.attribution(rows, ["a", "b"], "t", F.col("v"), "2026-01", "2026-02", ranked=False)
    got = {(r.dimension, r.member): r.base_value for r in found.collect()}
    assert got == {**{("a", str(i)): 20.0 for i in range(200)}, **{("b", str(i)): 20.0 for i in range(1, 200)},
                   ("b", None): 20.0}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    keys = [line for line in plan.splitlines() if "Aggregate [" in line and "spark_grouping_id" in line]
    assert keys and "Expand" in plan
    # No sum by the combinations comes before it.
    assert all("spark_grouping_id" in line or "Aggregate [sum" in line or "Aggregate [m0" not in line
               for line in plan.splitlines() if "Aggregate [" in line)
