"""All registered queries by operator id.

Double columns are rounded the same way on both sides, because the order of a
distributed sum, and with it the last bits, is not fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from workload import calls, diagnosis, loading, querylog, retrieval, scoring, sessions

_GROUPS = (loading, diagnosis, querylog, calls, sessions, scoring, retrieval)

# Sums of prices have two decimals, sums of discounted prices four.
_MONEY = {"revenue", "gmv", "net_gmv", "new_customer_gmv", "base_value", "current_value", "total", "value",
          "min", "max", "std", "avg"}
_DIGITS, _MONEY_DIGITS = 8, 4

# The double columns of each query that has SQL to compare with.
FLOATS: dict[str, tuple[str, ...]] = {
    "A2_csv_type_override": ("c_acctbal",),
    "A5_jsonl_scan": ("value",),
    "A6_jsonl_overwrite": ("total",),
    "A7_jsonl_append": ("total",),
    "B5_null_ratio": ("null_ratio",),
    "B8_profile": ("null_ratio",),
    "B9_summarize": ("avg", "std", "q25", "q50", "q75", "null_percentage"),
    "C2_period_trend": ("revenue",),
    "C3_period_in_list": ("revenue",),
    "C4_drill_down": ("revenue",),
    "C5_channel_split": ("revenue",),
    "C6_slice_series": ("revenue",),
    "C7_scalar_sum": ("revenue",),
    "C8_exclusion_breakdown": ("revenue",),
    "C9_period_change": ("base_value", "current_value", "change"),
    "C10_contribution": ("base_value", "current_value", "change", "contribution"),
    "C11_slice_metrics": ("outer_change", "inner_change", "inner_contribution"),
    "C12_attribution_scan": ("base_value", "current_value", "change", "contribution"),
    "C13_named_metrics": ("gmv", "net_gmv", "new_customer_gmv"),
    "C14_by_customer_segment": ("revenue",),
    "C15_by_product_brand": ("net_gmv",),
    "C16_totals": ("revenue",),
    "C17_capped_result": ("o_totalprice",),
    "C18_limit": ("revenue",),
    "C19_ground_truth_tasks": ("total_change", "member_change", "contribution", "base_value"),
    "D9_sql_similarity": ("similarity",),
    "D10_text_match": ("score",),
    "F8_redundant_rate": ("redundant_query_rate",),
    "F9_recovery_pairs": ("similarity",),
    "F14_session_stats": ("redundant_query_rate",),
    "A9_trajectory_scan": ("a",),
    "A10_task_scan": ("contribution",),
    "A11_reward_sink": ("total",),
    "F14_record_stats": ("redundant_query_rate",),
    "G1_diagnosis": ("final_diagnosis", "diagnosis_match"),
    "G2_key_numbers": ("key_numbers",),
    "G4_value_grounding": ("evidence",),
    "G5_recovery_bonus": ("recovery",),
    "G6_penalties": ("illegal_sql", "duplicate_sql", "over_budget"),
    "G7_total": ("total",),
    "H1_task_success_rate": ("task_success_rate",),
    "H2_root_cause_accuracy": ("root_cause_accuracy",),
    "H3_evidence_faithfulness": ("evidence_faithfulness",),
    "H4_sql_execution_rate": ("sql_execution_rate",),
    "H5_recovery_success_rate": ("recovery_success_rate",),
    "H6_long_horizon_sr": ("long_horizon_sr",),
    "H7_average_calls": ("avg_tool_calls", "avg_sql_calls", "avg_context_calls"),
    "H8_median_sql_calls": ("median_sql_calls",),
    "H9_redundant_query_rate": ("redundant_query_rate",),
    "H10_illegal_timeout_rate": ("illegal_sql_rate", "timeout_rate"),
    "H11_final_answer_rate": ("final_answer_rate",),
    "H12_average_reward": ("avg_reward",),
    "H15_report": ("value",),
    "I2_idf": ("idf",),
    "I3_cosine_norms": ("norm",),
    "I3_search": ("score",),
    "I4_boosts": ("boost",),
    "I5_filtered_search": ("score",),
    "I6_ranking": ("score",),
    "I7_retrieve": ("score",),
    "I8_extended_search": ("score",),
}


def _digits(column: str) -> int:
    return _MONEY_DIGITS if column in _MONEY else _DIGITS


def _rounded(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = query(spark, folder)
        # Adding 0.0 turns a negative zero into zero.
        return df.withColumns({f.name: F.round(f.name, _digits(f.name)) + 0.0 for f in df.schema.fields
                               if isinstance(f.dataType, T.DoubleType)})
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _rounded(q) for g in _GROUPS for k, q in g.QUERIES.items()}


def oracles() -> dict[str, str]:
    out = {}
    for g in _GROUPS:
        for name, sql in g.ORACLES.items():
            columns = FLOATS.get(name, ())
            if columns:
                rounded = ", ".join(f"round(CAST({c} AS DOUBLE), {_digits(c)}) + 0.0::DOUBLE AS {c}" for c in columns)
                sql = f"SELECT * REPLACE ({rounded}) FROM ({sql}\n)"
            out[name] = sql
    return out


