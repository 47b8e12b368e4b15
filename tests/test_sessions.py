import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from anomalens.config import Budget
from anomalens.operators import sessions as X
from anomalens.plans import ordered as O


def brute_force_kept(texts):
    """Walk in order, keep what is not close to a kept one (forms are plain here)."""
    kept = []
    for i, t in enumerate(texts):
        masked = re.sub(r"\b\d+\b", "?", t)
        if t and not any(masked == m or SequenceMatcher(None, t, k).ratio() >= 0.95 for _, k, m in kept):
            kept.append((i, t, masked))
    return [i for i, _, _ in kept]


def random_sessions(n_sessions, n_calls, seed):
    rng = random.Random(seed)
    stems = ["select alpha from table_of_things where key_column", "select alphb from table_of_things where key_column",
             "from beta group by one", "from betb group by one", "with gamma as something long enough to be close"]
    out = {}
    for s in range(n_sessions):
        calls = []
        for _ in range(n_calls):
            stem = rng.choice(stems)
            if rng.random() < 0.5:
                stem = stem.replace("a", rng.choice("axyz"), 1)
            calls.append("" if rng.random() < 0.05 else f"{stem} {rng.choice(['', rng.randint(1, 40)])}".strip())
        out[s] = calls
    return out


def steps_of(spark, sessions):
    rows = [(s, t, "execute_sql", q, True, None, None) for s, calls in sessions.items() for t, q in enumerate(calls)]
    return spark.createDataFrame(rows, "traj_id long, turn long, tool_name string, sql string, ok boolean, "
                                       "error string, error_type string").repartition(5)


@pytest.mark.parametrize("block", [3, 1024])
def test_duplicates_equal_brute_force(spark, block):
    """A block of three forms sends every session through the rounds."""
    sessions = random_sessions(4, 40, seed=7)
    sessions[9] = ["select 1"] * 5 + [""]
    got = {}
    for r in X.mark_duplicates(steps_of(spark, sessions), block=block, chunk_rows=7).collect():
        got.setdefault(r.traj_id, {})[r.idx] = r.is_duplicate
    for s, calls in sessions.items():
        kept = set(brute_force_kept(calls))
        assert got[s] == {i: bool(c) and i not in kept for i, c in enumerate(calls)}
    counts = {r.traj_id: r for r in X.duplicate_counts(steps_of(spark, sessions), block=block).collect()}
    assert counts[9].duplicate_sql_count == 4 and counts[9].redundant_query_rate == pytest.approx(4 / 6)


def test_only_kept_calls_count(spark):
    """A chain: the second is close to the first, the third only to the second."""
    base = "abcdefghijklmnopqrstuvwxyz0123456789abcd"
    chain = [base, "#" + base[:-1] + "z", "##" + base[:-3] + "zzz"]
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    assert ratio(chain[1], chain[0]) >= 0.95 and ratio(chain[2], chain[0]) < 0.95
    kept = X.kept_calls(steps_of(spark, {0: chain})).collect()
    assert sorted(r.turn for r in kept) == brute_force_kept(chain)


@pytest.mark.parametrize("chunk_rows", [4, 100_000])
def test_chunked_windows_equal_plain_ones(spark, chunk_rows):
    rng = random.Random(3)
    rows = [(k, p, rng.randint(-5, 5)) for k, n in ((1, 60), (2, 3), (None, 5)) for p in rng.sample(range(200), n)]
    df = spark.createDataFrame(rows, "k int, p long, v long").repartition(4)
    out = O.number_rows(df, "k", "p", "idx", chunk_rows)
    out = O.running(out, "k", "p", {"total": F.col("v")}, chunk_rows)
    out = O.previous(out, "k", "p", ["v"], chunk_rows=chunk_rows)
    got = {(r.k, r.p): (r.idx, r.total, r.prev_v) for r in out.collect()}
    want = {}
    for k in (1, 2, None):
        total, prev = 0, None
        for i, (_, p, v) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1])):
            total += v
            want[(k, p)] = (i, total, prev)
            prev = v
    assert got == want


@pytest.mark.parametrize("chunk_rows", [2, 100_000])
def test_recovery_pairs(spark, chunk_rows):
    a, fixed = "SELECT max(delay) FROM trips WHERE hour = 7", "SELECT max(delay) FROM trips WHERE hour = 8 AND wet"
    log = [(1, a, False), (2, fixed, True), (3, "TRUNCATE trips", False), (4, "FROM stations SELECT count(roof)", True),
           (5, a, False), (6, None, None), (7, fixed, True), (8, a, False), (9, a, False)]
    rows = [(0, t, "execute_sql" if ok is not None else "retrieve_context", q, ok if ok is not None else True, None, None)
            for t, q, ok in log]
    df = spark.createDataFrame(rows, "traj_id int, turn int, tool_name string, sql string, ok boolean, "
                                     "error string, error_type string")
    got = X.recovery_pairs(df, chunk_rows=chunk_rows).orderBy("fixed_idx").collect()
    assert [(r.failed_idx, r.fixed_idx) for r in got] == [(0, 1), (4, 5)]
    assert all(0.4 <= r.similarity < 1 for r in got)


def turns(spark, runs):
    rows = [(k, t, tool, chars, terminal) for k, run in runs.items() for t, (tool, chars, terminal) in enumerate(run)]
    return spark.createDataFrame(rows, "traj_id string, turn int, tool_name string, chars int, terminal boolean")


def test_budget_replay(spark):
    sql, ctx, idle, end = ("execute_sql", 10, False), ("retrieve_context", 10, False), (None, 10, False), ("final_answer", 1, True)
    runs = {"sql": [sql] * 5, "context": [ctx] * 3, "idle": [idle, sql, idle, sql, idle, end], "answer": [sql, end, sql],
            "turns": [sql, idle, ("other", 1, False)] * 3, "chars": [sql, (None, 95, False), sql, end]}
    got = {r.traj_id: (r.stop_turn, r.reason) for r in X.replay_budget(
        turns(spark, runs), Budget(max_turns=6, max_sql_calls=3, max_context_calls=1, max_chars=100)).collect()}
    assert got == {"sql": (3, "max_sql_calls"), "context": (1, "max_context_calls"), "idle": (4, "no_tool_call"),
                   "answer": (1, "final_answer"), "turns": (5, "max_turns"), "chars": (2, "budget_chars")}
    go_on = Budget(max_turns=6, max_sql_calls=2, max_context_calls=1, max_chars=1000, force_finish=False)
    got = X.replay_budget(turns(spark, {"x": [sql] * 4 + [end]}), go_on).first()
    assert (got.stop_turn, got.reason) == (4, "final_answer")


def test_counts_and_blocked_steps(spark):
    rows = [("a", 0, "execute_sql", True, None, None), ("a", 1, "execute_sql", False, "over_budget", None),
            ("a", 2, None, None, None, None), ("a", 3, "retrieve_context", True, None, None),
            ("a", 4, "execute_sql", False, "x", "timeout"), ("a", 5, "execute_sql", False, "x", None)]
    df = spark.createDataFrame(rows, "traj_id string, turn int, tool_name string, ok boolean, error string, error_type string")
    c = X.budget_flags(X.session_counts(df), Budget(max_sql_calls=3)).first()
    assert (c.n_turns, c.n_sql_calls, c.n_context_calls, c.timeout_count, c.failed_sql_count) == (6, 3, 1, 1, 1)
    assert (c.over_budget, c.used_all_sql_budget) == (False, True)
    assert [r.turn for r in X.blocked_steps(df).collect()] == [1]
    assert {r.tool_name: r.n_calls for r in X.tool_counts(df).collect()} == {"execute_sql": 3, "retrieve_context": 1}
