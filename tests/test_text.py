from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from anomalens.functions import similarity as M, sqltext as S, tokens as T, values as V
from anomalens.operators import querylog as Q
from anomalens.plans.spread import spread

LATE = "SELECT avg(delay) FROM trips WHERE line = 'U4'"
LATE_BY_HOUR = "SELECT hour(start), avg(delay) FROM trips WHERE line = 'U4' GROUP BY 1"


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.o for r in df.select("i", expr(F.col("c")).alias("o")).orderBy("i").collect()]


VERDICTS = {
    "SELECT line, max(delay) FROM trips GROUP BY line": ("ok", None),
    "WITH late AS (SELECT * FROM trips WHERE delay > 9) SELECT line FROM late": ("ok", None),
    "TRUNCATE trips": ("kind_not_allowed", "TRUNCATE"),
    "MERGE INTO stations USING trips ON false WHEN NOT MATCHED THEN INSERT VALUES (3)": ("kind_not_allowed", "MERGE"),
    "ALTER TABLE stations ADD COLUMN roof boolean": ("kind_not_allowed", "ALTER"),
    "DELETE FROM trips WHERE delay IS NULL": ("kind_not_allowed", "DELETE"),
    "CREATE TABLE copy_of_trips AS FROM trips": ("kind_not_allowed", "CREATE"),
    "TABLE stations; TABLE trips; TRUNCATE trips": ("multi_statement", "3"),
    "SELECT count(*) FROM read_parquet('trips/*.parquet')": ("banned_function", "read_parquet"),
    "   ": ("empty", None),
    "　\t": ("empty", None),
    "": ("empty", None),
    "SELECT dropped_off, inserted_by, altered FROM trips": ("ok", None),
    "SELECT line FROM trips WHERE remark = 'please TRUNCATE'": ("ok", None),
    "SELECT 'glob (everything)' AS hint FROM stations": ("ok", None),
    "-- only a comment": ("kind_not_allowed", "UNKNOWN"),
    "(SELECT 1) UNION (SELECT 2)": ("ok", None),
    "select 1 ; ;": ("ok", None),
    "WITH x AS (SELECT 1) DELETE FROM t; ": ("banned_keyword", "DELETE"),
    "SELECT glob\n('x')": ("banned_function", "glob"),
    "SELECT glob FROM t": ("ok", None),
    # a comment mark inside a literal hides the rest of its line
    "SELECT '--' ; DROP TABLE x": ("ok", None),
    "FROM 'file.csv'": ("ok", None),
}


def test_verdicts(spark):
    df = spark.createDataFrame([(q,) for q in VERDICTS] + [(None,)], "sql string")
    got = {r.sql: (r.verdict, r.hit) for r in Q.audit(df).collect()}
    assert got == {**VERDICTS, None: ("empty", None)}


def test_first_word_of_the_list_in_one_scan(spark):
    words = ["DROP", "COPY", "DELETE"]
    texts = ["copy and drop", "x delete copy", "dropped copy_of", "ſ drop_ DELETE.", "", None, "COPİ copy", "délete"]
    got = column(spark, texts, lambda c: S.keyword_hit(c, words))
    assert got == ["DROP", "COPY", None, "DELETE", None, None, "COPY", None]
    df = spark.createDataFrame([("x",)], "sql string").select(S.keyword_hit(F.col("sql"), words).alias("h"))
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_extract_all(") == 1 and "rlike" not in plan


def test_strict_audit_sees_behind_a_literal(spark):
    df = spark.createDataFrame([("SELECT '--' ; DROP TABLE x",)], "sql string")
    assert Q.audit(df, strict=True).first().verdict == "multi_statement"


def test_long_and_unterminated_literals(spark):
    long = "SELECT '" + "x''" * 20_000 + "' FROM t"
    got = column(spark, [long, "SELECT 'abc''def", "SELECT 'abc", 'a "b""c" d', "$$ drop ' $$ x"], S.strip_noise)
    assert got == ["SELECT '' FROM t", "SELECT '''def", "SELECT 'abc", 'a "" d', "'' x"]


def test_normal_form(spark):
    got = column(spark, ["  SELECT  a , b FROM ( t )  ; ", "/* x */ select 1.5, t2", "; ;", "A　B"], S.normalize)
    assert got == ["select a,b from (t)", "select 1.5,t2", "", "a b"]
    masked = column(spark, ["select 1.5, t2, 30"], lambda c: S.normalize(c, mask=True))
    assert masked == ["select ?,t2,?"]


def test_similarity_of_statements(spark):
    def near(a, b):  # of normal forms written out by hand
        return SequenceMatcher(None, a, b).ratio()
    late, by_hour = "select avg(delay) from trips where line = ''", "select hour(start),avg(delay) from trips where line = '' group by 1"
    pairs = [(LATE, LATE_BY_HOUR, near(late, by_hour)), ("TABLE stations ;", LATE, near("table stations", late)),
             ("SELECT  7", "select 23", near("select 7", "select 23")), ("", "/* y */", 1.0), ("", "TABLE trips", 0.0), (LATE.upper(), LATE, 1.0)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    for r in df.select("want", M.sql_similarity(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == pytest.approx(r.want, abs=5e-5)


def test_similarity_keeps_argument_order_and_long_texts(spark):
    a, b = "ab" * 150 + "tail", "tail" + "ba" * 150  # long enough for the popular-character rule
    df = spark.createDataFrame([(a, b), (b, a)], "a string, b string")
    got = [r[0] for r in df.select(M.form_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()]


def test_text_match(spark):
    df = spark.createDataFrame([("地铁四号线", "地铁四号线"), ("晚点集中在地铁四号线一段", "地铁四号线"), ("天气", "地铁四号线"),
                                (" Signal fault ", "signal"), (None, "x"), ("mnop", "nopq")], "p string, g string")
    got = [r[0] for r in df.select(M.text_match(F.col("p"), F.col("g"))).collect()]
    assert got == [1.0, 1.0, 0.0, 1.0, 0.0, 0.75]


def test_numeric_close(spark):
    cases = [("-0.2301", "-0.23", True), ("-0.23", "0.23", False), ("100", "100.5", True), ("abc", "1", False),
             ("nan", "nan", False), ("1_000", "1000", True), ("1.0d", "1", False), ("true", "1", True),
             (None, "1", False), ("0", "1e-10", True), ("inf", "inf", True)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    for r in df.select("*", V.numeric_close(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == r.want, r


def test_coerce(spark):
    cases = {"42": "42", "3.14": "3.14", "true": "true", "False": "false", "null": "null", "None": "null",
             "[1, 2]": "[1,2]", '{"a": 1}': '{"a":1}', "[{'a': 1}]": '[{"a":1}]', "1e-3": "0.001", "": '""',
             "SELECT a, b FROM t WHERE x = 1": '"SELECT a, b FROM t WHERE x = 1"', "[oops": '"[oops"',
             "12345678901234567890123": "12345678901234567890123"}
    got = column(spark, list(cases), lambda c: F.to_json(V.coerce_value(c)))
    assert got == list(cases.values())


def test_tokens(spark):
    got = column(spark, ["GMV 口径 gmv_1 1,2 区", "", "!!"], T.tokenize)
    assert got == [["gmv", "gmv_1", "1", "2", "口径", "径区", "口", "径", "区"], [], []]


def test_outcome_tally(spark):
    df = spark.createDataFrame([(True, None), (False, "illegal"), (False, "execution")], "ok boolean, error_type string")
    assert tuple(Q.outcome_tally(df).first()) == (3, 1, 1, 0, 1)


def test_normal_forms_of_a_list_equal_those_of_its_texts(spark):
    texts = ["", None, " ; select 1 ;; ", "a$$x'y$$b", "/* c */ f( 1 , 2 )", "x -- y\n z", "'it''s' , \"q\"\"r\"", "'never closed '' here", "( a ,b)", "f(x );", "$$ /* -- '"]
    df = spark.createDataFrame([(texts,)], "t array<string>")
    row = df.select(S.normalize_all(F.col("t")).alias("a"), F.transform("t", lambda x: S.normalize(x)).alias("b")).first()
    assert row.a == row.b


def test_heavy_rows_get_several_tasks_a_core(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(100).coalesce(1), 4).rdd.getNumPartitions() == 4 * cores
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == cores


def test_equal_records_are_compared_once_and_alike(spark):
    rows = [(["a b c", "a b d", ""], ["a b c", "a b ?", ""], [False, True, False], ["a b d", None], 0.95),
            ([], [], [], [], 0.95), (["x"], ["x"], [False], ["a b d"], 0.95)] * 40
    df = spark.createDataFrame(rows, "f array<string>, m array<string>, r array<boolean>, e array<string>, t double").coalesce(1)
    got = [r.x for r in df.select(M.session_comparisons("f", "m", "r", "e", "t").alias("x")).collect()]
    assert got[:3] * 40 == got
    assert got[0].kept == [True, True, False] and got[0].repair[1] == pytest.approx(0.8) and got[0].repair[::2] == [None, None]
    assert [tuple(b) for b in got[0].best] == [(1, 1.0), (-1, 0.0)]
    assert got[1].kept == [] and [tuple(b) for b in got[2].best] == [(-1, 0.0)]
    assert len(got) == 120
