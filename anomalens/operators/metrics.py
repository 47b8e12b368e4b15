"""Evaluation metrics over scored sessions: one global aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from anomalens.config import RewardWeights

LONG_SESSION_CALLS = 5


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _mean(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def metrics(scored: DataFrame, weights: RewardWeights = RewardWeights(),
            long_session_calls: int = LONG_SESSION_CALLS) -> DataFrame:
    """One row with every metric and count. Means over nothing are 0. Rates of
    calls are over all calls; the redundancy rate is the mean of session rates."""
    s = lambda name: F.col(f"stats.{name}")
    success = F.col("task_success").cast("double")
    calls, long = s("n_sql_calls"), s("n_sql_calls") >= long_session_calls
    failed, recovered = s("failed_sql_count") > 0, s("recovery_count") > 0
    evidence = _mean(F.col("evidence") / weights.evidence) if weights.evidence else F.lit(0.0)
    return scored.agg(
        F.count("*").alias("n"),
        _mean(success).alias("task_success_rate"),
        _mean(F.col("diagnosis_match")).alias("root_cause_accuracy"),
        evidence.alias("evidence_faithfulness"),
        _share(F.sum(s("n_ok_sql")), F.sum(calls)).alias("sql_execution_rate"),
        _share(F.count_if(failed & recovered), F.count_if(failed)).alias("recovery_success_rate"),
        _mean(F.when(long, success)).alias("long_horizon_sr"),
        _mean(s("n_turns")).alias("avg_tool_calls"),
        _mean(calls).alias("avg_sql_calls"),
        _mean(s("n_context_calls")).alias("avg_context_calls"),
        _mean(s("redundant_query_rate")).alias("redundant_query_rate"),
        _share(F.sum(s("illegal_sql_count")), F.sum(calls)).alias("illegal_sql_rate"),
        _share(F.sum(s("timeout_count")), F.sum(calls)).alias("timeout_rate"),
        _mean(F.col("has_final_answer").cast("double")).alias("final_answer_rate"),
        _mean(F.col("total")).alias("avg_reward"),
        F.count("diagnosis_match").alias("n_with_reference"),
        F.coalesce(F.sum(calls), F.lit(0)).alias("total_sql_calls"),
        F.count_if(failed).alias("n_traj_with_sql_failure"),
        F.count_if(long).alias("n_long_horizon"),
        F.lit(long_session_calls).cast("bigint").alias("long_horizon_min_sql"),
        # Exact: the aggregate keeps counts per distinct value, and calls per
        # session take few values.
        F.coalesce(F.median(calls), F.lit(0.0)).alias("median_sql_calls"),
        F.count_if(s("over_budget")).alias("over_budget_count"),
    )


def report(scored: DataFrame, weights: RewardWeights = RewardWeights(),
           long_session_calls: int = LONG_SESSION_CALLS) -> DataFrame:
    """The metrics as rows ``(metric, value)``; only ``n`` if there are no sessions."""
    wide = metrics(scored, weights, long_session_calls)
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                      for c in wide.columns])
    return wide.select("n", F.inline(cells)).filter("n > 0 OR metric = 'n'").drop("n")


def stop_reasons(scored: DataFrame) -> DataFrame:
    """How often each stop reason occurs."""
    return scored.groupBy("terminated_reason").agg(F.count("*").alias("n"))
