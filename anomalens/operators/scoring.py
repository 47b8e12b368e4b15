"""Verifiable scores of session records: one row in, one row out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from anomalens.config import EVIDENCE_SIMILARITY, NUMERIC_RTOL, Budget, RewardWeights
from anomalens.functions.similarity import clean, clean_match, contains_match
from anomalens.functions.values import close_numbers, to_number
from anomalens.operators.trajectories import with_stats

COMPONENTS = ("final_diagnosis", "key_numbers", "evidence", "recovery", "illegal_sql",
              "duplicate_sql", "over_budget")


def _present(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _share_hit(hits: Column) -> Column:
    return F.size(F.filter(F.map_values(hits), lambda v: v)) / F.size(hits)


def _evidence_entry(best: Column, finding: Column) -> Column:
    """Was the evidence run, and does the claimed value occur in its result?"""
    call = F.get("_sql", best["idx"])
    run = (best["idx"] >= 0) & (best["sim"] >= EVIDENCE_SIMILARITY)
    value = to_number(finding["value"])
    # The tolerance here is fixed; the configured one applies to key numbers only.
    grounded = call["has_rows"] & F.exists(
        F.flatten(call["rows"]), lambda cell: close_numbers(to_number(cell), value, NUMERIC_RTOL))
    return F.struct(run.alias("executed"),
                    (run & F.coalesce(grounded, F.lit(False))).alias("value_grounded"),
                    F.bround(best["sim"], 4).alias("similarity"))


def score(df: DataFrame, weights: RewardWeights = RewardWeights(),
          budget: Budget = Budget()) -> DataFrame:
    """Add ``stats``, the seven components, ``total``, ``diagnosis_match``,
    ``key_numbers_hit``, ``evidence_details``, ``has_final_answer`` and
    ``task_success`` to session records.

    ``diagnosis_match`` is NULL without an answer or without a reference.
    """
    df = with_stats(df, budget)
    answer, ref = F.col("final_answer"), F.col("reference")
    fields = ("diagnosis", "root_cause_dimension", "key_findings", "confidence")
    answered = answer.isNotNull() & F.coalesce(*[
        F.when(answer[f].isNotNull(), F.lit(True)) for f in fields], F.lit(False))
    gold, nums = ref["root_cause_dimension"], ref["key_numbers"]
    findings = F.filter(answer["key_findings"], lambda f: f.isNotNull())

    judged = answered & _present(gold)
    texts = df.withColumns({"_g": clean(gold), "_n": clean(F.when(judged, answer["root_cause_dimension"]))})
    # The full text matters only where the named dimension is no outright hit.
    texts = texts.withColumn("_t", clean(F.when(judged & ~contains_match(F.col("_n"), F.col("_g")).eqNullSafe(1.0), answer["diagnosis"])))
    compared = texts.withColumns({"_named": clean_match(F.col("_n"), F.col("_g")), "_told": clean_match(F.col("_t"), F.col("_g"))})
    match = F.when(judged, F.greatest("_named", "_told"))

    values = F.transform(findings, lambda f: to_number(f["value"]))
    hits = F.transform_values(nums, lambda _, g: F.coalesce(
        F.exists(values, lambda v: close_numbers(v, g, weights.numeric_rtol)), F.lit(False)))
    staged = compared.withColumns({
        "_match": match,
        "diagnosis_match": F.bround(match, 4),
        "key_numbers_hit": F.when(answered & (F.size(nums) > 0), hits),
        "evidence_details": F.when(answered & (F.size(findings) > 0), F.filter(F.transform(
            F.arrays_zip(F.col("_cmp.best").alias("b"), answer["key_findings"].alias("f")),
            lambda z: F.when(z["f"].isNotNull(), _evidence_entry(z["b"], z["f"]))),
            lambda e: e.isNotNull())),
    })
    zero = F.lit(0.0)
    tiers = F.aggregate("evidence_details", zero, lambda s, e: s
                        + F.when(e["executed"], 0.5).otherwise(0.0)
                        + F.when(e["value_grounded"], 0.5).otherwise(0.0))
    parts = {
        "final_diagnosis": F.coalesce(weights.final_diagnosis * F.col("_match"), zero),
        "key_numbers": F.coalesce(weights.key_numbers * _share_hit(F.col("key_numbers_hit")), zero),
        "evidence": F.coalesce(weights.evidence * (tiers / F.size("evidence_details")), zero),
        "recovery": F.when(F.col("stats.recovery_count") > 0, weights.recovery).otherwise(zero),
        "illegal_sql": weights.illegal_sql * F.col("stats.illegal_sql_count"),
        "duplicate_sql": weights.duplicate_sql * F.col("stats.duplicate_sql_count"),
        "over_budget": F.when(F.col("stats.over_budget"), weights.over_budget).otherwise(zero),
    }
    scored = staged.withColumns({n: parts[n] for n in COMPONENTS})
    total = F.lit(0.0)
    for name in COMPONENTS:
        total = total + F.col(name)
    m, numbers = F.col("diagnosis_match"), F.col("key_numbers_hit")
    success = (
        F.when(answer.isNull(), F.lit(False))
        .when(m.isNull(), _present(answer["root_cause_dimension"]))
        .otherwise((m >= 1.0) & F.coalesce(_share_hit(numbers) >= 0.5, F.lit(True)))
    )
    out = scored.withColumns({"total": total, "has_final_answer": answer.isNotNull(),
                              "task_success": success})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def reward_rows(scored: DataFrame, *keys: str) -> DataFrame:
    """The score columns alone (for ``sources.records.write_rewards``)."""
    return scored.select(*keys, "total", *COMPONENTS, "diagnosis_match", "key_numbers_hit",
                         "evidence_details", "task_success", "has_final_answer")
