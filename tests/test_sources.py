import csv
import gzip
import json
import os
from urllib.parse import unquote, urlparse

import pytest

from anomalens.operators import profile as P
from anomalens.sources import records as R, tables as S
from workload import scoring as W


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


@pytest.fixture()
def raw(tmp_path):
    write(tmp_path, "sales.csv", "id,code,day,amount\n1,007,2026-01-02,1.5\n2,010,2026-02-03,\n")
    write(tmp_path, "areas.csv", "name\n华东\n华北\n")
    return tmp_path


def test_csv_directory(spark, raw):
    assert S.csv_tables(spark, str(raw)) == ["areas", "sales"]
    df = S.read_csv(spark, f"{raw}/sales.csv")
    assert S.column_types(df) == {"id": "bigint", "code": "bigint", "day": "date", "amount": "double"}
    coded = S.read_csv(spark, f"{raw}/sales.csv", {"code": "STRING"})
    assert [r.code for r in coded.orderBy("id").collect()] == ["007", "010"]


def test_no_csv_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.csv_tables(spark, str(tmp_path))


def test_load_overwrites_all_or_same_named(spark, raw, tmp_path):
    assert S.load_csvs(spark, str(raw), "db_test", f"{tmp_path}/db") == ["areas", "sales"]
    spark.sql("CREATE TABLE db_test.other USING parquet AS SELECT 1 AS x")
    S.load_csvs(spark, str(raw), "db_test", f"{tmp_path}/db", overwrite=False)
    names = lambda: [r.table_name for r in S.list_tables(spark, "db_test").collect()]
    assert names() == ["areas", "other", "sales"]
    S.load_csvs(spark, str(raw), "db_test", f"{tmp_path}/db")
    assert names() == ["areas", "sales"] and spark.table("db_test.sales").count() == 2
    spark.sql("DROP DATABASE db_test CASCADE")


def test_jsonl(spark, tmp_path):
    write(tmp_path, "a.jsonl", '{"x": 1, "y": "a"}\n\n{"x": 2}\n')
    assert [tuple(r) for r in R.read_jsonl(spark, f"{tmp_path}/a.jsonl", "x int, y string").collect()] == [(1, "a"), (2, None)]
    assert R.read_jsonl(spark, f"{tmp_path}/missing.jsonl", "x int").count() == 0
    write(tmp_path, "bad.jsonl", '{"x": 1}\n{oops\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        R.read_jsonl(spark, f"{tmp_path}/bad.jsonl", "x int").collect()


def test_jsonl_sinks_count(spark, tmp_path):
    df, path = spark.range(5), f"{tmp_path}/out"
    assert (R.write_jsonl(df, path), R.append_jsonl(df.limit(2), path)) == (5, 2)
    assert R.read_jsonl(spark, path, "id long").count() == 7
    assert R.write_jsonl(df.limit(1), path) == 1 and R.read_jsonl(spark, path, "id long").count() == 1


def test_context_documents(spark, tmp_path):
    entries = [{"id": "a", "kind": "relation", "title": "t", "text": "x", "tags": ["g"], "tables": ["s"]}, {"id": "b"}]
    want = [("a", "relation", "t", "x", ["g"], ["s"]), ("b", "metric", "", "", [], [])]
    for name, doc in (("doc.json", {"entries": entries}), ("list.json", entries)):
        write(tmp_path, name, json.dumps(doc, indent=2))
        got = R.read_context(spark, f"{tmp_path}/{name}")
        assert [tuple(r)[:6] for r in got.orderBy("ord").collect()] == want
    assert R.read_context(spark, f"{tmp_path}/none.json").count() == 0
    R.write_context(got, f"{tmp_path}/lines")
    again = R.read_context(spark, f"{tmp_path}/lines", lines=True).orderBy("ord").collect()
    assert [tuple(r)[:6] for r in again] == want


def test_pretty_printed_trajectory(spark, tmp_path):
    rec = {"task_id": "t", "steps": [{"turn": 0, "tool_call": {"name": "f", "arguments": {"a": [1, {"b": "x"}]}},
                                      "tool_result": {"ok": True, "payload": {"rows": [[1, "x", None, 2.5, True]]}}}],
           "reference": {"key_numbers": {"k": 0.5}}, "meta": {"any": 1}}
    write(tmp_path, "t.json", json.dumps(rec, indent=2))
    r = R.read_trajectories(spark, f"{tmp_path}/t.json", multi_line=True).first()
    assert r.steps[0].tool_result.payload.rows == [["1", "x", None, "2.5", "true"]]
    assert r.steps[0].tool_call.arguments.toPython() == {"a": [1, {"b": "x"}]} and len(r.traj_id) == 64


def test_profile(spark):
    df = spark.createDataFrame([(1, "b", [1]), (2, None, [2]), (2, "a", [1]), (3, "a", None)], "n int, s string, l array<int>")
    rows = {r.column_name: r for r in P.profile(df, "t").collect()}
    assert (rows["n"].distinct_count, rows["n"].sample_values, rows["n"].row_count) == (3, ["1", "2", "3"], 4)
    assert (rows["s"].null_ratio, rows["s"].distinct_count, rows["s"].sample_values) == (0.25, 2, ["a", "b"])
    assert (rows["l"].distinct_count, rows["l"].sample_values) == (2, ["[1]", "[2]"])
    assert {r.distinct_count for r in P.profile(df, "t", max_distinct_scan=3).collect()} == {-1}
    approx = {r.column_name: r.distinct_count for r in P.distinct_counts(df, 3, approximate_above=True).collect()}
    assert approx["n"] == 3


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "n int, s string")
    assert [(r.row_count, r.null_ratio, r.distinct_count, r.sample_values) for r in P.profile(df, "t").collect()] == [(0, 0.0, 0, [])] * 2


def test_samples_are_the_smallest(spark):
    df = spark.range(10_000).selectExpr("9999 - id AS n", "cast(id % 3 AS string) AS s").repartition(7)
    got = {r.column_name: r.sample_values for r in P.samples(df).collect()}
    assert got == {"n": ["0", "1", "2", "3", "4"], "s": ["0", "1", "2"]}


def test_profile_entries(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    e = P.profile_entries(P.profile(df, "t")).first()
    assert (e.id, e.text, e.tags) == ("profile.t", "1 rows. Columns: n (int), s (string)", ["t", "n", "s"])


def test_csv_as_others_write_it(spark, tmp_path):
    write(tmp_path, "my table.csv", 'id,text\n1,"say ""hi"", ok"\n2,"two\nlines"\n3,""\n4,\n5, kept \n')
    assert S.csv_tables(spark, str(tmp_path)) == ["my table"]
    got = [tuple(r) for r in S.read_csv(spark, f"{tmp_path}/my table.csv").orderBy("id").collect()]
    assert got == [(1, 'say "hi", ok'), (2, "two\nlines"), (3, ""), (4, None), (5, " kept ")]


def test_csv_round_trip_and_other_readers(spark, tmp_path):
    rows = [(1, 'a "b", c\\'), (2, "x\ny"), (3, "x\r\ny"), (4, ""), (5, None), (6, "  "), (7, "\\"), (8, 'q"')]
    S.write_csv(spark.createDataFrame(rows, "id long, text string").coalesce(1), f"{tmp_path}/t.csv")
    assert [tuple(r) for r in S.read_csv(spark, f"{tmp_path}/t.csv").orderBy("id").collect()] == rows
    part = next((tmp_path / "t.csv").glob("part-*"))
    with part.open(newline="", encoding="utf-8") as f:
        assert [(int(i), t) for i, t in list(csv.reader(f))[1:]] == [(i, t or "") for i, t in rows]


def test_csv_types_come_from_all_rows(spark, tmp_path):
    write(tmp_path, "n.csv", "v\n" + "1\n" * 25_000 + "2.5\n")
    df = S.read_csv(spark, f"{tmp_path}/n.csv")
    assert S.column_types(df) == {"v": "double"} and df.agg({"v": "max"}).first()[0] == 2.5


def test_context_order_and_missing_ids(spark, tmp_path):
    df = spark.range(500).selectExpr("concat('e', id) AS id", "'metric' AS kind", "'' AS title", "repeat('x', cast(id % 50 as int)) AS text",
                                     "array('t') AS tags", "array('s') AS tables", "id * 3 AS ord").repartition(6)
    R.write_context(df, f"{tmp_path}/c")
    back = R.read_context(spark, f"{tmp_path}/c", lines=True)
    assert [(r.id, r.ord) for r in back.orderBy("ord").collect()] == [(f"e{i}", 3 * i) for i in range(500)]
    write(tmp_path, "bad.json", json.dumps([{"id": "a"}, {"title": "no id"}]))
    with pytest.raises(Exception, match="without an id"):
        R.read_context(spark, f"{tmp_path}/bad.json").collect()


def test_equal_records_are_different_sessions(spark, tmp_path):
    rec = {"task_id": "t", "question": "q", "steps": [{"turn": 0}]}
    write(tmp_path, "a.jsonl", "\n".join(json.dumps(r) for r in (rec, rec, {**rec, "error": "x"})))
    write(tmp_path, "b.jsonl", json.dumps(rec))
    df = R.read_trajectories(spark, f"{tmp_path}/*.jsonl")
    assert df.select("traj_id").distinct().count() == 4
    assert sorted(r[0] for r in df.select("traj_id").collect()) == sorted(r[0] for r in df.select("traj_id", "steps").collect())


def test_counts_are_exact_at_any_size(spark):
    df = spark.range(150_000).selectExpr("id", "id % 7 AS few", "repeat(cast(id % 3 as string), 100) AS long",
                                         "if(id % 2 = 0, -0.0D, 0.0D) AS zero", "nullif(id % 4, 0) AS some")
    got = {r.column_name: (r.row_count, r.null_ratio, r.distinct_count) for r in P.profile(df, "t", sample_n=0).collect()}
    assert got == {"id": (150_000, 0.0, 150_000), "few": (150_000, 0.0, 7), "long": (150_000, 0.0, 3), "zero": (150_000, 0.0, 1),
                   "some": (150_000, 0.25, 3)}


def test_variants_are_profiled_as_json(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("[2]",), ("[2]",), (None,)], "j string").selectExpr("parse_json(j) AS v")
    r = P.profile(df, "t").first()
    assert (r.distinct_count, r.null_ratio, r.sample_values) == (2, 0.25, ["[2]", '{"a":1}'])


def test_approximate_uniques_are_near(spark):
    df = spark.range(20_000).selectExpr("id", "id % 900 AS some")
    got = {r.column_name: r.approx_unique for r in P.summarize(df).collect()}
    assert abs(got["id"] - 20_000) < 2400 and abs(got["some"] - 900) < 110


def test_quartiles_are_exact(spark, monkeypatch):
    values = [float(x) for x in (5, -3, 7, 7, 1e300, -1e300, 2.5, 0.1, 1e-300, 3)] * 3
    df = spark.createDataFrame([(i, v, None) for i, v in enumerate(values)], "n int, v double, none double")
    odd = spark.createDataFrame([(x,) for x in (float("nan"), float("inf"), float("-inf"), 1.0, None)], "x double")
    same = spark.createDataFrame([(-0.0,), (0.0,), (0.0,)], "z double")

    def rank(xs, q):
        return sorted(xs)[max(1, -(-len(xs) * q // 4)) - 1]

    for rest in (0, 100_000):  # passes to the last value, or a few rows counted by value
        monkeypatch.setattr(P.exact_ranks, "__defaults__", (5, rest))
        got = {(r.table_name, r.column_name): (r.q25, r.q50, r.q75)
               for r in P.summarize_tables({"d": df, "o": odd, "s": same}).collect()}
        assert got["d", "v"] == tuple(rank(values, q) for q in (1, 2, 3))
        assert got["d", "n"] == tuple(rank(range(30), q) for q in (1, 2, 3))
        assert got["d", "none"] == (None, None, None)
        assert got["o", "x"] == (float("-inf"), 1.0, float("inf"))
        assert got["s", "z"] == (0.0, 0.0, 0.0)


def test_profile_of_many_tables(spark):
    a = spark.createDataFrame([(1, "x", [1.0]), (1, "y" * 100, [1.0]), (None, None, None)], "n int, `x.y` string, l array<double>")
    b = spark.createDataFrame([(0.0, b"a"), (-0.0, b"b")], "f double, b binary")
    got = {(r.table_name, r.column_name): (r.row_count, round(r.null_ratio, 3), r.distinct_count, len(r.sample_values))
           for r in P.profile_tables({"a": a, "b": b}).collect()}
    assert got == {("a", "n"): (3, 0.333, 1, 1), ("a", "x.y"): (3, 0.333, 2, 2), ("a", "l"): (3, 0.333, 1, 1),
                   ("b", "f"): (2, 0.0, 1, 1), ("b", "b"): (2, 0.0, 2, 2)}
    some = P.profile_tables({"a": a, "b": b}, max_distinct_scan=2).collect()
    assert {(r.table_name, r.distinct_count) for r in some} == {("a", -1), ("b", 1), ("b", 2)}
    assert P.profile_entries(P.listed_tables({"b": b})).first().text == "2 rows. Columns: f (double), b (binary)"


def test_csv_files_are_short(spark, tmp_path):
    at = str(tmp_path / "t.csv")
    S.write_csv(spark.range(25_000).coalesce(1).selectExpr("id", "concat('a\nb', id) AS t"), at)
    assert len(list((tmp_path / "t.csv").glob("part-*"))) == 3
    assert S.read_csv(spark, at).agg({"id": "sum"}).first()[0] == 25_000 * 24_999 // 2


def test_session_records_take_little_disk(spark, tmp_path):
    spark.range(25_000).coalesce(1).selectExpr("id AS o_orderkey", "id % 1500 AS o_custkey", "'F' AS o_orderstatus",
                                   "'1-URGENT' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    df = W.trajectory_scan(spark, str(tmp_path))
    assert {(r.task_id, r.n_turns, r.a) for r in df.select("task_id", "n_turns", "a").collect()} == {
        (str(i), i % 7 + 1, float(i % 1500 % 10)) for i in range(25_000)}
    files = [unquote(urlparse(f).path) for f in df.inputFiles()]
    assert sum(map(os.path.getsize, files)) < 25_000 * 200  # plain lines have 1300 bytes each
    lines = [json.loads(line) for f in files for line in gzip.open(f, "rt", encoding="utf-8")]
    assert len(lines) == 25_000 and {len(r["steps"]) for r in lines} == set(range(1, 8))
    assert {"task_id", "messages", "steps", "final_answer", "terminated_reason", "budget", "reference"} == {k for r in lines for k in r}


def test_session_records_go_to_short_files(spark, tmp_path):
    df = spark.range(25_000).coalesce(1).selectExpr("cast(id AS string) AS task_id", "array(struct('user' AS role, concat('é\n\"', id) AS content)) AS messages",
                                                    "map('x', cast(NULL AS double)) AS meta", "cast(NULL AS string) AS error")
    assert R.write_trajectories(df, f"{tmp_path}/t") == 25_000
    assert len(list((tmp_path / "t").glob("part-*.gz"))) == 3
    back = R.read_trajectories(spark, f"{tmp_path}/t")
    assert back.select("traj_id").distinct().count() == 25_000
    assert {(r.task_id, r.messages[0].content) for r in back.select("task_id", "messages").collect()} == {(str(i), f'é\n"{i}') for i in range(25_000)}
    assert R.write_trajectories(df.limit(0), f"{tmp_path}/t") == 0 and R.read_trajectories(spark, f"{tmp_path}/t").count() == 0
