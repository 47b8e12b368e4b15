import json

import pytest

from anomalens.operators import metrics as H, scoring as G, sessions as X, trajectories as N
from anomalens.sources import records as R

A = "SELECT avg(delay) FROM trips WHERE line = '西线'"
A_FIXED = A + " AND hour(start) = 8"
B = "FROM stations SELECT max(platforms)"
REF = {"root_cause_dimension": "西线 signal", "key_numbers": {"delay": 6.5}}


def answer(dim="西线 signal", text="delays rose because the 西线 signal failed", findings=((6.5, A),)):
    return {"diagnosis": text, "root_cause_dimension": dim, "key_findings": [
        {"claim": "c", "value": v, "evidence_sql": q} for v, q in findings]}


def step(i, sql, ok=True, error_type=None, tool="execute_sql", error=None, rows=((6.5, 41.0),)):
    return {"turn": i, "tool_call": {"name": tool, "arguments": {"sql": sql}, "malformed": False},
            "tool_result": {"ok": ok, "error": error or (None if ok else "boom"), "payload": {
                "ok": ok, "error_type": error_type, "rows": [list(r) for r in rows] if ok else []}}}


def record(name, calls, final=None, ref=None, reason="final_answer", **budget):
    limits = {"max_turns": 10, "max_sql_calls": 8, "max_context_calls": 3, "max_chars": 60000, **budget}
    return {"task_id": name, "question": "q", "messages": [{"role": "user", "content": "abc"}, {"role": "x"}],
            "steps": [step(i, *c) if isinstance(c, tuple) else c for i, c in enumerate(calls)],
            "final_answer": final, "terminated_reason": reason, "budget": limits, "reference": ref or {}}


METRICS_SQL = ("WITH d AS (FROM trips SELECT line, month(start) AS m, avg(delay) AS late GROUP BY ALL) "
               "SELECT x.late / y.late AS growth, x.late - y.late AS minutes, count(*) AS n FROM d x, d y")
NUMBERS = {"growth": 1.625, "minutes": 2.5, "share": 0.8125}

RECORDS = [
    record("full_marks", [(A,)], answer(), REF),
    record("wrong_cause", [(A,)], answer("wet", "mud"), REF),
    record("no_answer", [(A,)], None, REF),
    record("fabricated", [(A,)], answer(findings=((6.5, "TABLE nothing -- not run"),)), REF),
    record("not_grounded", [(A,)], answer(findings=((987.0, A),)), REF),
    record("illegal", [("DELETE FROM trips", False, "illegal"), (B,)]),
    record("duplicate", [(A,), (A,)]),
    record("respelled", [(A,), (A.lower().replace(" ", "  "),)]),
    record("different", [(A,), (B,)]),
    record("over_budget", [(A,), (A,)], max_sql_calls=1),
    record("no_recovery", [("DELETE FROM trips", False, "illegal"), (B,)]),
    record("recovery", [(A, False, "execution"), (A_FIXED,)]),
    record("still_failing", [(A, False, "execution"), (A_FIXED, False, "execution")]),
    record("fine_then_fine", [(A,), (A_FIXED,)]),
    record("no_gold", [(A,)], answer(), {}),
    record("blocked", [(A,), step(1, A, False, None, "execute_sql", "over_budget"),
                       step(2, "", True, None, "retrieve_context")]),
    record("empty", []),
    record("good_demo", [
        step(0, "", True, None, "retrieve_context"),
        ("FROM trips SELECT line, count(*) AS n, avg(delay) GROUP BY line",),
        ("SELECT hour(start), median(delay) FROM trips WHERE line = '西线' GROUP BY 1 ORDER BY 2 DESC",),
        step(3, METRICS_SQL, rows=[tuple(NUMBERS.values())]),
        step(4, "", True, None, "final_answer")],
        answer(findings=[(v, METRICS_SQL) for v in NUMBERS.values()]), {**REF, "key_numbers": NUMBERS}),
    record("bad_demo", [("DELETE FROM trips", False, "illegal"), (B,), (B,),
                        ("TABLE no_such_table", False, "execution"), step(4, "", True, None, "final_answer")],
           answer("wet", "mud", ((987.0, "FROM x -- invented"),)), REF),
]


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("log") / "runs.jsonl"
    path.write_text("\n\n".join(json.dumps(r, ensure_ascii=False) for r in RECORDS), encoding="utf-8")
    return R.read_trajectories(spark, str(path))


@pytest.fixture(scope="module")
def scored(records):
    return {r.task_id: r for r in G.score(records).drop("meta", "steps").collect()}


def near(x):
    return pytest.approx(x, abs=1e-9)


@pytest.mark.parametrize("name,column,want", [
    ("full_marks", "final_diagnosis", 0.55), ("full_marks", "key_numbers", 0.20), ("full_marks", "evidence", 0.15),
    ("full_marks", "task_success", True), ("wrong_cause", "final_diagnosis", 0.0),
    ("wrong_cause", "task_success", False), ("no_answer", "total", 0.0), ("no_answer", "diagnosis_match", None),
    ("no_answer", "task_success", False), ("fabricated", "evidence", 0.0), ("not_grounded", "evidence", 0.075),
    ("illegal", "illegal_sql", -0.03), ("duplicate", "duplicate_sql", -0.02), ("respelled", "duplicate_sql", -0.02),
    ("different", "duplicate_sql", 0.0), ("over_budget", "over_budget", -0.10), ("no_recovery", "recovery", 0.0),
    ("recovery", "recovery", 0.10), ("still_failing", "recovery", 0.0), ("fine_then_fine", "recovery", 0.0),
    ("no_gold", "diagnosis_match", None), ("no_gold", "task_success", True), ("empty", "total", 0.0),
    ("good_demo", "total", 0.90), ("good_demo", "task_success", True), ("bad_demo", "total", -0.05),
    ("bad_demo", "task_success", False),
])
def test_scores(scored, name, column, want):
    got = scored[name][column]
    assert got == (near(want) if isinstance(want, float) else want)


def test_total_is_the_sum_of_components(scored):
    for r in scored.values():
        assert r.total == near(sum(r[c] for c in G.COMPONENTS))


def test_record_stats(scored):
    s = scored["blocked"].stats
    assert (s.n_turns, s.n_sql_calls, s.n_context_calls, s.duplicate_sql_count) == (3, 1, 1, 0)
    assert scored["duplicate"].stats.duplicate_indices == [1]
    assert scored["recovery"].stats.recovered_indices == [1]
    assert scored["duplicate"].stats.redundant_query_rate == near(0.5)
    assert scored["empty"].stats.redundant_query_rate == 0.0 and scored["empty"].stats.char_length == 3


def test_flat_log_agrees_with_records(records):
    """The in-row statistics and those of the exploded step log are the same."""
    nested = {r.traj_id: r for r in N.with_stats(records).select("traj_id", "stats.*").collect()}
    flat = X.session_stats(N.explode_steps(records)).collect()
    names = ("n_turns", "n_sql_calls", "n_context_calls", "n_ok_sql", "failed_sql_count",
             "duplicate_sql_count", "recovery_count")
    assert len(flat) == len(RECORDS) - 1  # a record without steps has no rows
    for r in flat:
        assert [r[n] for n in names] == [nested[r.traj_id][n] for n in names]


def test_metrics(records):
    m = H.metrics(G.score(records)).first()
    n = len(RECORDS)
    assert m.n == n and m.n_with_reference == 6
    assert m.task_success_rate == near(4 / n)  # full marks, fabricated, no gold, good demo
    assert m.root_cause_accuracy == near(4 / 6)
    assert m.n_traj_with_sql_failure == 5 and m.recovery_success_rate == near(1 / 5)
    assert m.long_horizon_sr == 0.0 and m.n_long_horizon == 0
    assert m.median_sql_calls == 2.0 and m.over_budget_count == 1
    assert {r.terminated_reason: r.n for r in H.stop_reasons(records).collect()} == {"final_answer": n}


def test_report_of_no_sessions(records):
    rows = H.report(G.score(records.filter("false"))).collect()
    assert [(r.metric, r.value) for r in rows] == [("n", 0.0)]


def test_reward_rows_round_trip(spark, records, tmp_path):
    path = str(tmp_path / "rewards")
    assert R.write_rewards(G.reward_rows(G.score(records), "task_id"), path) == len(RECORDS)
    back = R.read_jsonl(spark, path, "task_id string, total double").collect()
    assert {r.task_id: r.total for r in back}["good_demo"] == 0.9
