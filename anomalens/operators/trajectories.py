"""Statistics of session records, inside the row.

A record carries its whole session (``sources.records.TRAJECTORY``), so every
number is an expression over its arrays: no explode, no shuffle, one scan. Long
flat logs are the business of ``operators.sessions``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from anomalens.config import (
    CONTEXT_TOOL, DUPLICATE_SIMILARITY, EXECUTION, ILLEGAL, OVER_BUDGET, RECOVERY_SIMILARITY,
    SQL_TOOL, TIMEOUT, Budget,
)
from anomalens.functions import similarity as M, sqltext as S
from anomalens.operators.sessions import char_length


def with_sessions(df: DataFrame, threshold: float = DUPLICATE_SIMILARITY) -> DataFrame:
    """Add the working columns of a record: ``_done`` (steps that were carried
    out), ``_sql`` (its SQL calls with outcome and result cells) and ``_cmp`` (all
    text comparisons the record needs)."""
    done = F.filter("steps", lambda s: s["tool_result"].isNotNull()
                    & ~s["tool_result"]["error"].eqNullSafe(OVER_BUDGET))
    call = lambda s: F.struct(
        F.coalesce(F.try_variant_get(s["tool_call"]["arguments"], "$.sql", "string"), F.lit("")).alias("sql"),
        F.coalesce(s["tool_result"]["ok"], F.lit(False)).alias("ok"),
        s["tool_result"]["payload"]["error_type"].alias("error_type"),
        F.coalesce(s["tool_result"]["payload"]["ok"], F.lit(False)).alias("has_rows"),
        s["tool_result"]["payload"]["rows"].alias("rows"))
    calls = F.transform(F.filter("_done", lambda s: s["tool_call"]["name"].eqNullSafe(SQL_TOOL)), call)
    repairs = F.transform("_sql", lambda c, i: F.coalesce(
        c["ok"] & ~F.get("_sql", i - 1)["ok"], F.lit(False)))
    none = F.array().cast("array<string>")
    evidence = F.coalesce(S.normalize_all(F.transform(
        "final_answer.key_findings",
        lambda f: F.when(f["evidence_sql"] != "", f["evidence_sql"]))), none)
    return (
        df.withColumn("_done", F.coalesce(done, F.array().cast(df.schema["steps"].dataType)))
        .withColumn("_sql", calls)
        .withColumn("_forms", S.normalize_all(F.col("_sql.sql")))
        .withColumn("_masked", F.transform("_forms", S.mask_numbers))
        .withColumn("_cmp", M.session_comparisons(
            F.col("_forms"), F.col("_masked"), repairs, evidence, F.lit(threshold)))
    )


def _count(items: str, test) -> Column:
    return F.size(F.filter(items, test)).cast("bigint")


def _limit(name: str, default: int) -> Column:
    return F.coalesce(F.col("budget")[name], F.lit(default))


def with_stats(df: DataFrame, budget: Budget = Budget(), threshold: float = DUPLICATE_SIMILARITY,
               min_similarity: float = RECOVERY_SIMILARITY) -> DataFrame:
    """Add a struct ``stats``: turns, SQL and context calls, outcomes, duplicates,
    recoveries, budget use, characters. A record's own ``budget`` wins over the
    default."""
    df = with_sessions(df, threshold)
    dup = F.filter(
        F.transform(F.arrays_zip(F.col("_forms").alias("f"), F.col("_cmp.kept").alias("k")),
                    lambda z, i: F.when((z["f"] != "") & ~z["k"], i)),
        lambda i: i.isNotNull())
    fixed = F.filter(
        F.transform("_cmp.repair", lambda s, i: F.when(s >= min_similarity, i)),
        lambda i: i.isNotNull())
    kind = lambda t: _count("_sql", lambda c: c["error_type"] == t)
    counted = df.withColumns({
        "_dup": dup, "_fixed": fixed,
        "_n_turns": F.coalesce(F.size("steps"), F.lit(0)).cast("bigint"),
        "_n_sql": F.size("_sql").cast("bigint"),
        "_n_ctx": _count("_done", lambda s: s["tool_call"]["name"].eqNullSafe(CONTEXT_TOOL)),
    })
    n_sql, n_turns, n_ctx = F.col("_n_sql"), F.col("_n_turns"), F.col("_n_ctx")
    n_dup = F.size("_dup").cast("bigint")
    illegal, execution, timeout = kind(ILLEGAL), kind(EXECUTION), kind(TIMEOUT)
    stats = F.struct(
        n_turns.alias("n_turns"), n_sql.alias("n_sql_calls"), n_ctx.alias("n_context_calls"),
        _count("_sql", lambda c: c["ok"]).alias("n_ok_sql"),
        illegal.alias("illegal_sql_count"), execution.alias("execution_error_count"),
        timeout.alias("timeout_count"), (illegal + execution + timeout).alias("failed_sql_count"),
        F.col("_dup").alias("duplicate_indices"), n_dup.alias("duplicate_sql_count"),
        F.col("_fixed").alias("recovered_indices"),
        F.size("_fixed").cast("bigint").alias("recovery_count"),
        F.coalesce(F.try_divide(n_dup, n_sql), F.lit(0.0)).alias("redundant_query_rate"),
        ((n_sql > _limit("max_sql_calls", budget.max_sql_calls))
         | (n_turns > _limit("max_turns", budget.max_turns))
         | (n_ctx > _limit("max_context_calls", budget.max_context_calls))).alias("over_budget"),
        (n_sql >= _limit("max_sql_calls", budget.max_sql_calls)).alias("used_all_sql_budget"),
        F.coalesce(char_length(F.col("messages")), F.lit(0)).alias("char_length"),
    )
    return counted.withColumn("stats", stats).drop("_dup", "_fixed", "_n_turns", "_n_sql", "_n_ctx")


def explode_steps(df: DataFrame, key: str = "traj_id") -> DataFrame:
    """Records as a flat step log for ``operators.sessions``. ``turn`` is the place
    in the record, so it is unique whatever the record says."""
    one = df.select(F.col(key).alias("traj_id"), F.posexplode("steps").alias("turn", "s"))
    call, result = F.col("s.tool_call"), F.col("s.tool_result")
    return one.select(
        "traj_id", F.col("turn").cast("bigint").alias("turn"),
        call["name"].alias("tool_name"),
        F.try_variant_get(call["arguments"], "$.sql", "string").alias("sql"),
        F.when(result.isNotNull(), F.coalesce(result["ok"], F.lit(False))).alias("ok"),
        result["error"].alias("error"), result["payload"]["error_type"].alias("error_type"))
