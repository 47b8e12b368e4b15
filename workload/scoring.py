"""Session records derived from ``orders``: every order becomes one session with
its calls, results, reference and final answer. Spark builds the nested records
from the row; the SQL side follows the same rules over unnested steps.

Rules, with o = o_orderkey, c = o_custkey, k = c % 10:
* o % 7 + 1 steps; step i is of kind (o + i * (c % 5 + 1)) % 6
  0 sales query over k, ok, result cells k and 100.5
  1 limit query, fails in execution        2 context call
  3 table query, ok, no matching cells     4 illegal statement
  5 sales query over k + 1, blocked by the budget if o % 3 = 0, else timed out
* no answer if o % 9 = 0; findings: k (wrong for odd o) with the sales query as
  evidence, and 0.5 with a query never run unless o % 4 = 0
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from anomalens.operators import diagnosis as D, metrics as H, scoring as G, trajectories as N
from anomalens.plans.storage import scratch_path
from anomalens.sources import records as R
from workload.tables import heavy, table

_SALES = "'SELECT region, SUM(gmv) FROM sales WHERE day = ' || {k} || ' GROUP BY 1'"
_STEP = f"""
named_struct(
 'turn', i,
 'tool_call', named_struct(
   'name', if(kind = 2, 'retrieve_context', 'execute_sql'),
   'arguments', to_variant_object(map('sql', CASE kind
      WHEN 0 THEN {_SALES.format(k='k')}
      WHEN 1 THEN 'from t_ limit ' || k
      WHEN 3 THEN 'WITH x AS (VALUES (' || k || ')) TABLE x'
      WHEN 4 THEN 'VACUUM jobs ' || k
      WHEN 5 THEN {_SALES.format(k='((k + 1) % 10)')} END))),
 'tool_result', named_struct(
   'ok', kind IN (0, 2, 3),
   'error', CASE WHEN kind = 5 AND o_orderkey % 3 = 0 THEN 'over_budget' WHEN kind IN (1, 4, 5) THEN 'failed' END,
   'payload', named_struct(
      'ok', kind IN (0, 3),
      'error_type', CASE kind WHEN 1 THEN 'execution' WHEN 4 THEN 'illegal' WHEN 5 THEN 'timeout' END,
      'rows', CASE kind WHEN 0 THEN array(array(cast(k AS string), '100.5'))
                        WHEN 3 THEN array(array('77', NULL)) END)))"""

_GOLD = "CASE o_orderstatus WHEN 'F' THEN 'market' WHEN 'O' THEN 'union' END"
_PRED = "CASE o_custkey % 3 WHEN 0 THEN 'the Market' WHEN 1 THEN ' union' ELSE 'xyz' END"
_TOLD = "CASE o_custkey % 4 WHEN 0 THEN 'fell at market' ELSE 'why' END"
_REASON = ("CASE WHEN o_orderkey % 9 <> 0 THEN 'final_answer' WHEN o_orderkey % 2 = 0 THEN 'max_turns' "
           "ELSE 'max_sql_calls' END")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """One session record per order (the fields the operators read)."""
    step = F.expr("transform(transform(sequence(0, cast(o_orderkey % 7 AS int)), i -> named_struct("
                  "'i', i, 'kind', (o_orderkey + i * (o_custkey % 5 + 1)) % 6)), s -> "
                  + _STEP.replace("kind", "s.kind").replace("'turn', i", "'turn', s.i") + ")")
    evidence = _SALES.format(k="k").replace("SELECT region, SUM(gmv)", "select  region,sum( gmv )")
    finding = "named_struct('claim', 'c', 'value', {v}, 'evidence_sql', {e})"
    first = finding.format(v="if(o_orderkey % 2 = 0, cast(k AS string), '12345')", e=evidence)
    second = finding.format(v="'0.5'", e="'SELECT 1 -- never run'")
    return heavy(spark, sf, "orders", 4).withColumn("k", F.expr("o_custkey % 10")).select(
        F.col("o_orderkey").cast("string").alias("task_id"),
        F.expr("array(named_struct('role', 'system', 'content', o_orderstatus), "
               "named_struct('role', 'user', 'content', o_orderpriority))").alias("messages"),
        step.alias("steps"),
        F.expr(f"""CASE WHEN o_orderkey % 9 <> 0 THEN named_struct(
            'diagnosis', {_TOLD}, 'root_cause_dimension', {_PRED},
            'key_findings', if(o_orderkey % 4 = 0, array({first}), array({first}, {second})),
            'confidence', 0.5D) END""").alias("final_answer"),
        F.expr(_REASON).alias("terminated_reason"),
        F.expr("named_struct('max_turns', 6, 'max_sql_calls', 4, 'max_context_calls', 1, "
               "'max_chars', 60000)").alias("budget"),
        F.expr(f"""named_struct('root_cause_dimension', {_GOLD}, 'key_numbers',
            if(o_orderkey % 5 = 0, map('a', cast(k AS double), 'c', 777.0D),
               map('a', cast(k AS double), 'b', 0.502D)))""").alias("reference"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return G.score(records(spark, sf))


def _parts(*names: str):
    return lambda s, d: _scored(s, d).select("task_id", *names)


def trajectory_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as JSONL and scanned with the explicit schema."""
    path = scratch_path(spark, "trajectories")
    R.write_trajectories(records(spark, sf), path)
    back = N.with_stats(R.read_trajectories(spark, path))
    return back.select("task_id", "terminated_reason", "stats.n_turns", "stats.n_sql_calls",
                       "stats.duplicate_sql_count",
                       F.col("reference.key_numbers")["a"].alias("a"))


def task_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "tasks")
    R.write_jsonl(D.ground_truth(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate",
                                 F.col("o_totalprice")), path)
    return R.read_tasks(spark, path).select(
        "task_id", F.col("reference.key_numbers")["contribution"].alias("contribution"))


def reward_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "rewards")
    n = R.write_rewards(G.reward_rows(_scored(spark, sf), "task_id"), path)
    back = R.read_jsonl(spark, path, "task_id string, total double, task_success boolean")
    return back.withColumn("written", F.lit(n).cast("bigint"))


def record_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = N.with_stats(records(spark, sf)).select("task_id", "stats.*")
    return s.withColumns({c: F.array_join(c, ",") for c in ("duplicate_indices", "recovered_indices")})


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    e = _scored(spark, sf).select("task_id", F.posexplode("evidence_details").alias("pos", "e"))
    return e.select("task_id", "pos", "e.executed")


def grounding(spark: SparkSession, sf: str) -> DataFrame:
    e = _scored(spark, sf)
    g = F.transform("evidence_details", lambda x: x["value_grounded"])
    return e.select("task_id", F.array_join(g.cast("array<string>"), ",").alias("grounded"), "evidence")


def _metrics(*names: str):
    return lambda s, d: H.metrics(_scored(s, d)).select(*names)


QUERIES = {
    "A9_trajectory_scan": trajectory_scan,
    "A10_task_scan": task_scan,
    "A11_reward_sink": reward_sink,
    "F14_record_stats": record_stats,
    "G1_diagnosis": _parts("final_diagnosis", "diagnosis_match"),
    "G2_key_numbers": lambda s, d: _scored(s, d).select(
        "task_id", "key_numbers", *[F.col("key_numbers_hit")[n].alias(f"hit_{n}") for n in "abc"]),
    "G3_evidence_run": evidence,
    "G4_value_grounding": grounding,
    "G5_recovery_bonus": _parts("recovery"),
    "G6_penalties": _parts("illegal_sql", "duplicate_sql", "over_budget"),
    "G7_total": _parts("total"),
    "G8_success": _parts("task_success", "has_final_answer"),
    "H1_task_success_rate": _metrics("task_success_rate"),
    "H2_root_cause_accuracy": _metrics("root_cause_accuracy", "n_with_reference"),
    "H3_evidence_faithfulness": _metrics("evidence_faithfulness"),
    "H4_sql_execution_rate": _metrics("sql_execution_rate", "total_sql_calls"),
    "H5_recovery_success_rate": _metrics("recovery_success_rate", "n_traj_with_sql_failure"),
    "H6_long_horizon_sr": _metrics("long_horizon_sr", "n_long_horizon", "long_horizon_min_sql"),
    "H7_average_calls": _metrics("avg_tool_calls", "avg_sql_calls", "avg_context_calls"),
    "H8_median_sql_calls": _metrics("median_sql_calls"),
    "H9_redundant_query_rate": _metrics("redundant_query_rate"),
    "H10_illegal_timeout_rate": _metrics("illegal_sql_rate", "timeout_rate"),
    "H11_final_answer_rate": _metrics("final_answer_rate"),
    "H12_average_reward": _metrics("avg_reward"),
    "H13_stop_reasons": lambda s, d: H.stop_reasons(records(s, d)),
    "H14_over_budget_count": _metrics("over_budget_count"),
    "H15_report": lambda s, d: H.report(_scored(s, d)),
}

# kind 0 and 5 share a masked form, every other kind has its own.
_STEPS = """
SELECT o_orderkey AS o, o_custkey % 10 AS k, i, (o_orderkey + i * (o_custkey % 5 + 1)) % 6 AS kind
FROM (SELECT *, unnest(range(o_orderkey % 7 + 1)) AS i FROM orders)"""
_SQLS = f"""
SELECT *, row_number() OVER w - 1 AS idx, lag(kind) OVER w AS prev_kind,
  row_number() OVER (PARTITION BY o, CASE kind WHEN 5 THEN 0 ELSE kind END ORDER BY i) > 1 AS dup
FROM ({_STEPS}) WHERE kind <> 2 AND NOT (kind = 5 AND o % 3 = 0)
WINDOW w AS (PARTITION BY o ORDER BY i)"""
_STATS = f"""
SELECT o_orderkey AS o, o_orderkey % 7 + 1 AS n_turns, coalesce(n_sql, 0) AS n_sql_calls, coalesce(n_ctx, 0) AS n_context_calls,
  coalesce(n_ok, 0) AS n_ok_sql, coalesce(n_ill, 0) AS illegal_sql_count,
  coalesce(n_exe, 0) AS execution_error_count, coalesce(n_tim, 0) AS timeout_count,
  coalesce(n_ill + n_exe + n_tim, 0) AS failed_sql_count, coalesce(dups, '') AS duplicate_indices,
  coalesce(n_dup, 0) AS duplicate_sql_count, coalesce(fixed, '') AS recovered_indices,
  coalesce(n_fix, 0) AS recovery_count, coalesce(n_dup / n_sql, 0) AS redundant_query_rate,
  coalesce(n_sql, 0) > 4 OR o_orderkey % 7 + 1 > 6 OR coalesce(n_ctx, 0) > 1 AS over_budget,
  coalesce(n_sql, 0) >= 4 AS used_all_sql_budget,
  length(o_orderstatus) + length(o_orderpriority) AS char_length
FROM orders LEFT JOIN (SELECT o, count(*) AS n_sql, count(*) FILTER (kind IN (0, 3)) AS n_ok,
    count(*) FILTER (kind = 4) AS n_ill, count(*) FILTER (kind = 1) AS n_exe,
    count(*) FILTER (kind = 5) AS n_tim, count(*) FILTER (dup) AS n_dup,
    string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (dup) AS dups,
    count(*) FILTER (prev_kind = 5 AND kind = 0) AS n_fix,
    string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (prev_kind = 5 AND kind = 0) AS fixed
  FROM ({_SQLS}) GROUP BY o) s ON o_orderkey = s.o
LEFT JOIN (SELECT o, count(*) AS n_ctx FROM ({_STEPS}) WHERE kind = 2 GROUP BY o) c ON o_orderkey = c.o"""
_SCORES = f"""
WITH base AS (
  SELECT orders.*, o_custkey % 10 AS k, o_orderkey % 9 <> 0 AS answered, {_GOLD} AS gold, {_PRED} AS pred, {_TOLD} AS told,
    coalesce(has0, false) AS has0, coalesce(has5, false) AS has5 FROM orders
  LEFT JOIN (SELECT o, bool_or(kind = 0) AS has0, bool_or(kind = 5) AS has5 FROM ({_SQLS}) GROUP BY 1) e
    ON o_orderkey = e.o),
m AS (
  SELECT base.*, CASE WHEN answered AND gold IS NOT NULL THEN CASE WHEN contains(lower(pred), gold)
      OR contains(told, gold) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END AS diagnosis_match,
    CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END AS n_find,
    (answered AND o_orderkey % 2 = 0) AS hit_a, (answered AND o_orderkey % 4 <> 0) AS hit_b,
    answered AND (has0 OR has5) AS run1, answered AND has0 AND o_orderkey % 2 = 0 AS grounded1 FROM base),
p AS (
  SELECT m.*, s.* EXCLUDE (o), coalesce(0.55 * diagnosis_match, 0) AS final_diagnosis,
    CASE WHEN answered THEN 0.2 * ((CASE WHEN hit_a THEN 1 ELSE 0 END
       + CASE WHEN o_orderkey % 5 <> 0 AND hit_b THEN 1 ELSE 0 END) / 2) ELSE 0 END AS key_numbers,
    0.15 * ((CASE WHEN run1 THEN 0.5 ELSE 0 END + CASE WHEN grounded1 THEN 0.5 ELSE 0 END) / n_find) AS evidence,
    CASE WHEN recovery_count > 0 THEN CAST(0.1 AS DOUBLE) ELSE 0 END AS recovery,
    CAST(-0.03 AS DOUBLE) * illegal_sql_count AS illegal_sql,
    CAST(-0.02 AS DOUBLE) * duplicate_sql_count AS duplicate_sql,
    CASE WHEN s.over_budget THEN CAST(-0.1 AS DOUBLE) ELSE 0 END AS over_budget_penalty
  FROM m JOIN ({_STATS}) s ON s.o = o_orderkey)
SELECT *, CAST(o_orderkey AS VARCHAR) AS task_id,
  CAST(final_diagnosis + key_numbers + evidence + recovery + illegal_sql + duplicate_sql + over_budget_penalty AS DOUBLE) AS total,
  CASE WHEN NOT answered THEN false WHEN diagnosis_match IS NULL THEN true
    WHEN diagnosis_match < 1 THEN false ELSE key_numbers >= 0.1 - 1e-9 END AS task_success
FROM p"""
_S = f"({_SCORES})"

_METRICS = {
    "n": "count(*)",
    "task_success_rate": "avg(CASE WHEN task_success THEN 1.0 ELSE 0.0 END)",
    "root_cause_accuracy": "avg(diagnosis_match)",
    "evidence_faithfulness": "avg(CAST(evidence AS DOUBLE) / 0.15)",
    "sql_execution_rate": "sum(n_ok_sql) / sum(n_sql_calls)",
    "recovery_success_rate": "count(*) FILTER (failed_sql_count > 0 AND recovery_count > 0) "
                             "/ count(*) FILTER (failed_sql_count > 0)",
    "long_horizon_sr": "avg(CASE WHEN task_success THEN 1.0 ELSE 0.0 END) FILTER (n_sql_calls >= 5)",
    "avg_tool_calls": "avg(n_turns)",
    "avg_sql_calls": "avg(n_sql_calls)",
    "avg_context_calls": "avg(n_context_calls)",
    "redundant_query_rate": "avg(redundant_query_rate)",
    "illegal_sql_rate": "sum(illegal_sql_count) / sum(n_sql_calls)",
    "timeout_rate": "sum(timeout_count) / sum(n_sql_calls)",
    "final_answer_rate": "avg(CASE WHEN answered THEN 1.0 ELSE 0.0 END)",
    "avg_reward": "avg(total)",
    "n_with_reference": "count(diagnosis_match)",
    "total_sql_calls": "CAST(sum(n_sql_calls) AS BIGINT)",
    "n_traj_with_sql_failure": "count(*) FILTER (failed_sql_count > 0)",
    "n_long_horizon": "count(*) FILTER (n_sql_calls >= 5)",
    "long_horizon_min_sql": "CAST(5 AS BIGINT)",
    "median_sql_calls": "median(n_sql_calls)",
    "over_budget_count": "count(*) FILTER (over_budget)",
}


def _metric_sql(*names: str) -> str:
    return "SELECT " + ", ".join(f"{_METRICS[n]} AS {n}" for n in names) + f" FROM {_S}"


ORACLES = {
    "A9_trajectory_scan": f"""
SELECT CAST(o_orderkey AS VARCHAR) AS task_id, {_REASON} AS terminated_reason, n_turns, n_sql_calls,
  duplicate_sql_count, CAST(o_custkey % 10 AS DOUBLE) AS a FROM orders JOIN ({_STATS}) s ON s.o = o_orderkey""",
    "A10_task_scan": """
WITH v AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS mt,
             sum(o_totalprice) AS value FROM orders GROUP BY ALL),
t AS (SELECT mt, sum(value) AS total FROM v GROUP BY ALL),
p AS (SELECT c.*, b.total AS base_total FROM t c JOIN t b ON b.mt = c.mt - INTERVAL 1 MONTH),
m AS (SELECT DISTINCT o_orderpriority, mt FROM v
      UNION SELECT o_orderpriority, CAST(mt + INTERVAL 1 MONTH AS DATE) FROM v),
b AS (SELECT m.*, strftime(m.mt, '%Y-%m') AS month, p.total, p.base_total, coalesce(c.value, 0) AS value,
        coalesce(a.value, 0) AS base_value
  FROM m JOIN p ON m.mt = p.mt
  LEFT JOIN v c ON m.o_orderpriority IS NOT DISTINCT FROM c.o_orderpriority AND c.mt = m.mt
  LEFT JOIN v a ON m.o_orderpriority IS NOT DISTINCT FROM a.o_orderpriority AND a.mt = m.mt - INTERVAL 1 MONTH)
SELECT 'o_orderpriority=' || o_orderpriority || '@' || month AS task_id,
  coalesce(round((value - base_value) / nullif(total - base_total, 0), 6), 0) AS contribution FROM b""",
    "A11_reward_sink": f"""
SELECT task_id, round(total, 6) AS total, task_success, (SELECT count(*) FROM orders) AS written FROM {_S}""",
    "F14_record_stats": f"SELECT CAST(o AS VARCHAR) AS task_id, * EXCLUDE (o) FROM ({_STATS})",
    "G1_diagnosis": f"SELECT task_id, final_diagnosis, diagnosis_match FROM {_S}",
    "G2_key_numbers": f"""
SELECT task_id, CAST(key_numbers AS DOUBLE) AS key_numbers, CASE WHEN answered THEN hit_a END AS hit_a,
  CASE WHEN answered AND o_orderkey % 5 <> 0 THEN hit_b END AS hit_b,
  CASE WHEN answered AND o_orderkey % 5 = 0 THEN false END AS hit_c FROM {_S}""",
    "G3_evidence_run": f"""
SELECT task_id, 0 AS pos, run1 AS executed FROM {_S} WHERE answered
UNION ALL SELECT task_id, 1 AS pos, false AS executed FROM {_S} WHERE answered AND n_find = 2""",
    "G4_value_grounding": f"""
SELECT task_id, CAST(evidence AS DOUBLE) AS evidence, CASE WHEN answered THEN
  CAST(grounded1 AS VARCHAR) || CASE WHEN n_find = 2 THEN ',false' ELSE '' END END AS grounded FROM {_S}""",
    "G5_recovery_bonus": f"SELECT task_id, recovery FROM {_S}",
    "G6_penalties": f"SELECT task_id, illegal_sql, duplicate_sql, over_budget_penalty AS over_budget FROM {_S}",
    "G7_total": f"SELECT task_id, total FROM {_S}",
    "G8_success": f"SELECT task_id, task_success, answered AS has_final_answer FROM {_S}",
    "H1_task_success_rate": _metric_sql("task_success_rate"),
    "H2_root_cause_accuracy": _metric_sql("root_cause_accuracy", "n_with_reference"),
    "H3_evidence_faithfulness": _metric_sql("evidence_faithfulness"),
    "H4_sql_execution_rate": _metric_sql("sql_execution_rate", "total_sql_calls"),
    "H5_recovery_success_rate": _metric_sql("recovery_success_rate", "n_traj_with_sql_failure"),
    "H6_long_horizon_sr": _metric_sql("long_horizon_sr", "n_long_horizon", "long_horizon_min_sql"),
    "H7_average_calls": _metric_sql("avg_tool_calls", "avg_sql_calls", "avg_context_calls"),
    "H8_median_sql_calls": _metric_sql("median_sql_calls"),
    "H9_redundant_query_rate": _metric_sql("redundant_query_rate"),
    "H10_illegal_timeout_rate": _metric_sql("illegal_sql_rate", "timeout_rate"),
    "H11_final_answer_rate": _metric_sql("final_answer_rate"),
    "H12_average_reward": _metric_sql("avg_reward"),
    "H13_stop_reasons": f"SELECT {_REASON} AS terminated_reason, count(*) AS n FROM orders GROUP BY 1",
    "H14_over_budget_count": _metric_sql("over_budget_count"),
    "H15_report": "WITH r AS (" + _metric_sql(*_METRICS) + ")\n" + "\nUNION ALL\n".join(
        f"SELECT '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM r" for n in _METRICS),
}
