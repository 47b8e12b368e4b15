"""Session analytics over the query log derived from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from anomalens.config import Budget
from anomalens.operators import sessions as X
from workload.querylog import FORMS, LOG, query_log
from workload.tables import table

BUDGET = Budget(max_turns=40, max_sql_calls=16, max_context_calls=6, max_chars=1500,
                turns_without_call=5)


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return query_log(spark, sf).drop("value")


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).withColumns({
        "chars": F.length("sql"),
        "terminal": F.col("tool_name").eqNullSafe("final_answer") & (F.col("turn") % 20 == 9)})


def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    d = X.mark_duplicates(_log(spark, sf))
    return d.select("traj_id", "turn", F.col("idx").cast("bigint").alias("idx"), "is_duplicate")


def char_length(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation turn as a record of two messages."""
    c = table(spark, sf, "conversations")
    messages = F.array(F.struct(F.lit("system").alias("role"), F.col("role").alias("content")),
                       F.struct(F.col("role").alias("role"), F.col("text").alias("content")))
    return c.select("conv_id", "turn", X.char_length(messages).alias("chars"))


QUERIES = {
    "F1_executed_steps": lambda s, d: X.executed_steps(_log(s, d)).select("traj_id", "turn", "tool_name"),
    "F2_blocked_steps": lambda s, d: X.blocked_steps(_log(s, d)).select("traj_id", "turn", "tool_name"),
    "F3_sql_calls": lambda s, d: X.sql_calls(_log(s, d)).select(
        "traj_id", "turn", F.col("idx").cast("bigint").alias("idx"), "sql"),
    "F4_call_counts": lambda s, d: X.session_counts(_log(s, d)).select(
        "traj_id", "n_turns", "n_sql_calls", "n_context_calls"),
    "F5_error_counts": lambda s, d: X.session_counts(_log(s, d)).select(
        "traj_id", "illegal_sql_count", "execution_error_count", "timeout_count"),
    "F6_failed_count": lambda s, d: X.session_counts(_log(s, d)).select("traj_id", "failed_sql_count"),
    "F7_duplicate_calls": duplicates,
    "F8_redundant_rate": lambda s, d: X.duplicate_counts(_log(s, d)),
    "F9_recovery_pairs": lambda s, d: X.recovery_pairs(_log(s, d)).select(
        "traj_id", F.col("failed_idx").cast("bigint").alias("failed_idx"),
        F.col("fixed_idx").cast("bigint").alias("fixed_idx"), "similarity"),
    "F10_over_budget": lambda s, d: X.budget_flags(X.session_counts(_log(s, d)), BUDGET).select(
        "traj_id", "over_budget"),
    "F11_sql_budget_used": lambda s, d: X.budget_flags(X.session_counts(_log(s, d)), BUDGET).select(
        "traj_id", "used_all_sql_budget"),
    "F12_char_length": char_length,
    "F13_budget_replay": lambda s, d: X.replay_budget(_turns(s, d), BUDGET),
    "F14_session_stats": lambda s, d: X.session_stats(_log(s, d), BUDGET),
    "F15_tool_counts": lambda s, d: X.tool_counts(_log(s, d)),
}

_DONE = "ok IS NOT NULL AND error IS DISTINCT FROM 'over_budget'"
_SQL = f"{_DONE} AND tool_name = 'execute_sql'"
_COUNTS = f"""
SELECT traj_id, count(*) AS n_turns, count(*) FILTER ({_SQL}) AS n_sql_calls,
  count(*) FILTER ({_DONE} AND tool_name = 'retrieve_context') AS n_context_calls,
  count(*) FILTER ({_SQL} AND ok) AS n_ok_sql,
  count(*) FILTER ({_SQL} AND error_type = 'illegal') AS illegal_sql_count,
  count(*) FILTER ({_SQL} AND error_type = 'execution') AS execution_error_count,
  count(*) FILTER ({_SQL} AND error_type = 'timeout') AS timeout_count,
  count(*) FILTER ({_SQL} AND error_type IN ('illegal', 'execution', 'timeout')) AS failed_sql_count
FROM {LOG} GROUP BY 1"""
_CALLS = f"""
SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY turn) - 1 AS idx,
  form <> '' AND row_number() OVER (PARTITION BY traj_id, masked_form ORDER BY turn) > 1 AS is_duplicate,
  lag(masked_form) OVER w AS prev_form, lag(ok) OVER w AS prev_ok
FROM {FORMS} WHERE {_SQL} WINDOW w AS (PARTITION BY traj_id ORDER BY turn)"""
_FLAGS = (f"n_sql_calls > {BUDGET.max_sql_calls} OR n_turns > {BUDGET.max_turns} "
          f"OR n_context_calls > {BUDGET.max_context_calls}")
_FIXED = f"SELECT * FROM ({_CALLS}) WHERE NOT prev_ok AND ok AND prev_form = masked_form"
_REDUNDANT = f"""
SELECT traj_id, count(*) AS n_sql_calls, count(*) FILTER (is_duplicate) AS duplicate_sql_count,
  count(*) FILTER (is_duplicate) / count(*) AS redundant_query_rate FROM ({_CALLS}) GROUP BY 1"""

ORACLES = {
    "F1_executed_steps": f"SELECT traj_id, turn, tool_name FROM {LOG} WHERE {_DONE}",
    "F2_blocked_steps": f"""
SELECT traj_id, turn, tool_name FROM {LOG} WHERE ok IS NOT NULL AND error = 'over_budget'""",
    "F3_sql_calls": f"SELECT traj_id, turn, idx, sql FROM ({_CALLS})",
    "F4_call_counts": f"SELECT traj_id, n_turns, n_sql_calls, n_context_calls FROM ({_COUNTS})",
    "F5_error_counts": f"""
SELECT traj_id, illegal_sql_count, execution_error_count, timeout_count FROM ({_COUNTS})""",
    "F6_failed_count": f"SELECT traj_id, failed_sql_count FROM ({_COUNTS})",
    "F7_duplicate_calls": f"SELECT traj_id, turn, idx, is_duplicate FROM ({_CALLS})",
    "F8_redundant_rate": _REDUNDANT,
    "F9_recovery_pairs": f"""
SELECT traj_id, idx - 1 AS failed_idx, idx AS fixed_idx, CAST(1 AS DOUBLE) AS similarity FROM ({_FIXED})""",
    "F10_over_budget": f"SELECT traj_id, {_FLAGS} AS over_budget FROM ({_COUNTS})",
    "F11_sql_budget_used": f"""
SELECT traj_id, n_sql_calls >= {BUDGET.max_sql_calls} AS used_all_sql_budget FROM ({_COUNTS})""",
    "F12_char_length": "SELECT conv_id, turn, length(role) + length(text) AS chars FROM conversations",
    "F13_budget_replay": f"""
WITH r AS (SELECT *, row_number() OVER w AS turn_no,
    count(*) FILTER (tool_name = 'execute_sql') OVER w AS nsql,
    count(*) FILTER (tool_name = 'retrieve_context') OVER w AS nctx,
    count(*) FILTER (tool_name IS NULL) OVER w AS idle, sum(length(sql)) OVER w AS chars
  FROM {LOG} WINDOW w AS (PARTITION BY traj_id ORDER BY turn)),
j AS (SELECT *, CASE WHEN tool_name IS NULL THEN CASE WHEN idle >= {BUDGET.turns_without_call} THEN 'no_tool_call' END
    WHEN tool_name = 'execute_sql' AND nsql > {BUDGET.max_sql_calls} THEN 'max_sql_calls'
    WHEN tool_name = 'retrieve_context' AND nctx > {BUDGET.max_context_calls} THEN 'max_context_calls'
    WHEN tool_name = 'final_answer' AND turn % 20 = 9 THEN 'final_answer'
    WHEN chars > {BUDGET.max_chars} THEN 'budget_chars' END AS reason
  FROM r WHERE turn_no <= {BUDGET.max_turns}),
s AS (SELECT traj_id, coalesce(min(turn_no) FILTER (reason IS NOT NULL), max(turn_no)) AS n_turns FROM j GROUP BY 1)
SELECT j.traj_id, j.turn AS stop_turn, s.n_turns, coalesce(j.reason, CASE WHEN s.n_turns = {BUDGET.max_turns} THEN 'max_turns' ELSE 'log_end' END) AS reason
FROM j JOIN s ON j.traj_id = s.traj_id AND j.turn_no = s.n_turns""",
    "F14_session_stats": f"""
SELECT c.*, {_FLAGS.replace('n_', 'c.n_')} AS over_budget,
  c.n_sql_calls >= {BUDGET.max_sql_calls} AS used_all_sql_budget,
  coalesce(r.duplicate_sql_count, 0) AS duplicate_sql_count,
  coalesce(round_even(r.redundant_query_rate, 4), 0) AS redundant_query_rate,
  coalesce(f.n, 0) AS recovery_count
FROM ({_COUNTS}) c LEFT JOIN ({_REDUNDANT}) r ON c.traj_id = r.traj_id
LEFT JOIN (SELECT traj_id, count(*) AS n FROM ({_FIXED}) GROUP BY 1) f ON c.traj_id = f.traj_id""",
    "F15_tool_counts": f"""
SELECT tool_name, count(*) AS n_calls FROM {LOG} WHERE {_DONE} AND tool_name IS NOT NULL GROUP BY 1""",
}
