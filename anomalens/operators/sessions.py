"""Analytics over a flat log of session steps.

A step is one row: ``traj_id``, ``turn`` (whole number, unique within the
session), ``tool_name`` (NULL if the turn had no call), ``sql``, ``ok`` (NULL if
the call was never carried out), ``error``, ``error_type``. A session may be of
any length, also a large share of the whole log: counts combine map-side, ordered
work runs on chunks of the session (``plans.ordered``), and duplicates are
decided block by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from anomalens.config import (
    CONTEXT_TOOL, DUPLICATE_SIMILARITY, EXECUTION, ILLEGAL, OVER_BUDGET, RECOVERY_SIMILARITY,
    SQL_TOOL, TIMEOUT, Budget,
)
from anomalens.functions import similarity as M, sqltext as S
from anomalens.plans.ordered import CHUNK_ROWS, chunking, number_rows, previous
from anomalens.plans.skew import join_unique
from anomalens.plans.storage import cut_lineage

KEY, POSITION = "traj_id", "turn"
# Forms that one task walks; segments keep that close to linear.
BLOCK_FORMS = 20_000
_SALTS = 16


def _executed() -> Column:
    return F.col("ok").isNotNull() & ~F.col("error").eqNullSafe(OVER_BUDGET)


def _is_sql() -> Column:
    return _executed() & F.col("tool_name").eqNullSafe(SQL_TOOL)


def executed_steps(steps: DataFrame) -> DataFrame:
    """Steps that were carried out (blocked ones do not count)."""
    return steps.filter(_executed())


def blocked_steps(steps: DataFrame) -> DataFrame:
    """Steps stopped by the budget."""
    return steps.filter(F.col("ok").isNotNull() & F.col("error").eqNullSafe(OVER_BUDGET))


def sql_calls(steps: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Carried-out SQL calls with their 0-based ``idx`` in the session; a missing
    text is empty."""
    return number_rows(_sql_steps(steps), KEY, POSITION, "idx", chunk_rows)


def _sql_steps(steps: DataFrame) -> DataFrame:
    return steps.filter(_is_sql()).withColumn("sql", F.coalesce("sql", F.lit("")))


def tool_counts(steps: DataFrame) -> DataFrame:
    """Calls per tool that reached the tool."""
    return (steps.filter(_executed() & F.col("tool_name").isNotNull())
            .groupBy("tool_name").agg(F.count("*").alias("n_calls")))


def session_counts(steps: DataFrame) -> DataFrame:
    """Per session: turns, SQL and context calls, successful calls, failures by
    kind, and their sum (a failure without a kind is not counted)."""
    kind = F.col("error_type")
    counts = steps.groupBy(KEY).agg(
        F.count("*").alias("n_turns"),
        F.count_if(_is_sql()).alias("n_sql_calls"),
        F.count_if(_executed() & F.col("tool_name").eqNullSafe(CONTEXT_TOOL)).alias("n_context_calls"),
        F.count_if(_is_sql() & F.col("ok")).alias("n_ok_sql"),
        F.count_if(_is_sql() & (kind == ILLEGAL)).alias("illegal_sql_count"),
        F.count_if(_is_sql() & (kind == EXECUTION)).alias("execution_error_count"),
        F.count_if(_is_sql() & (kind == TIMEOUT)).alias("timeout_count"),
    )
    return counts.withColumn("failed_sql_count", F.col("illegal_sql_count")
                             + F.col("execution_error_count") + F.col("timeout_count"))


def budget_flags(counts: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Add ``over_budget`` (a limit exceeded) and ``used_all_sql_budget``."""
    return counts.withColumns({
        "over_budget": (F.col("n_sql_calls") > budget.max_sql_calls)
        | (F.col("n_turns") > budget.max_turns)
        | (F.col("n_context_calls") > budget.max_context_calls),
        "used_all_sql_budget": F.col("n_sql_calls") >= budget.max_sql_calls,
    })


def _forms(calls: DataFrame) -> DataFrame:
    """Distinct normal forms per session, by first position. A repeated form is a
    duplicate whatever happened to the first one, so only firsts are compared;
    counting them combines map-side."""
    return (calls.withColumn("form", S.normalize(F.col("sql"))).filter("form <> ''")
            .groupBy(KEY, "form").agg(F.min(POSITION).alias("first"))
            .withColumn("masked", S.mask_numbers(F.col("form"))))


def _as_lists(forms: DataFrame) -> DataFrame:
    """One row per session with its ordered forms (the caller bounds their number)."""
    lists = forms.groupBy(KEY).agg(
        F.array_sort(F.collect_list(F.struct("first", "form", "masked"))).alias("f"))
    return lists.withColumn("none", F.transform("f", lambda _: F.lit(False)))


def _decide(lists: DataFrame, dropped: str, threshold: float) -> DataFrame:
    """Keep or drop every form of the lists."""
    flags = M.kept_forms(F.col("f.form"), F.col("f.masked"), F.col(dropped), F.lit(threshold))
    return lists.withColumn("kept", F.filter(
        F.transform(F.arrays_zip(F.col("f").alias("f"), flags.alias("k")),
                    lambda z: F.when(z["k"], z["f"])), lambda x: x.isNotNull()))


def kept_calls(calls: DataFrame, threshold: float = DUPLICATE_SIMILARITY,
               block: int = BLOCK_FORMS) -> DataFrame:
    """Positions of the SQL calls that repeat no earlier kept call.

    Calls are walked in order; a call is dropped if its normal form is close to
    that of an earlier kept call or equal to it under the number mask. Sessions
    with up to ``block`` distinct forms are decided in one pass. Longer ones go on
    in rounds: the next ``block`` undecided forms are compared with all kept ones
    (in blocks spread over the cluster), decided in order, and every undecided form
    whose masked form was just kept drops out. No pairs are emitted, no list
    exceeds ``block`` forms, and each round continues from written data.
    """
    forms = _forms(calls)
    if chunking(calls, POSITION, block).single:
        # No session can have more positions, hence forms, than one block.
        rest = None
    else:
        forms = cut_lineage(forms)
        largest = forms.groupBy(KEY).count().agg(F.max("count")).first()[0] or 0
        rest = forms if largest > block else None
    if rest is None:
        kept = _decide(_as_lists(forms), "none", threshold)
        return kept.select(KEY, F.explode("kept").alias("k")).select(KEY, F.col("k.first").alias(POSITION))

    done: DataFrame | None = None
    number = 0
    while not rest.isEmpty():
        # A limit per group is applied before the shuffle: at most ``block`` rows
        # per session leave a task.
        order = Window.partitionBy(KEY).orderBy("first")
        lists = _as_lists(rest.withColumn("_r", F.row_number().over(order))
                          .filter(F.col("_r") <= block).drop("_r"))
        dropped = "none"
        if done is not None:
            lists, dropped = _against(lists, done, threshold), "dropped"
        new = cut_lineage(_decide(lists, dropped, threshold).select(
            KEY, F.lit(number).alias("round"), F.array_max("f.first").alias("upto"), "kept"))
        rest = cut_lineage(_undecided(rest, new))
        done = new if done is None else done.unionByName(new)
        number += 1
    return done.select(KEY, F.explode("kept").alias("k")).select(KEY, F.col("k.first").alias(POSITION))


def _against(lists: DataFrame, done: DataFrame, threshold: float) -> DataFrame:
    """Mark the forms of the lists that are close to a form kept in a past round."""
    known = done.select(F.col(KEY).alias("_k"), "round", F.col("kept.form").alias("known"))
    pairs = lists.select(KEY, F.col("f.form").alias("forms")).join(known, F.col(KEY).eqNullSafe(F.col("_k")))
    # One comparison of two blocks is the unit of work; spread them.
    near = pairs.repartition(KEY, "round").withColumn(
        "near", M.close_to_any(F.col("forms"), F.col("known"), F.lit(threshold)))
    hits = (near.select(F.col(KEY).alias("_h"), F.posexplode("near").alias("pos", "hit")).filter("hit")
            .groupBy("_h").agg(F.collect_set("pos").alias("hits")))
    out = lists.join(hits, F.col(KEY).eqNullSafe(F.col("_h")), "left")
    flags = F.transform("f", lambda _, i: F.coalesce(F.array_contains("hits", i), F.lit(False)))
    return out.withColumn("dropped", flags).drop("_h", "hits")


def _undecided(rest: DataFrame, new: DataFrame) -> DataFrame:
    """Forms behind the decided block whose masked form was not just kept."""
    sizes = rest.groupBy(F.col(KEY)).agg(F.count("*").alias("n"))
    upto = new.select(F.col(KEY).alias("_u"), "upto").join(sizes, F.col("_u").eqNullSafe(F.col(KEY))).select(
        KEY, "n", "upto")
    behind = (join_unique(rest, upto, KEY, "n").filter(F.col("first") > F.col("upto")).drop("upto")
              .withColumn("_salt", F.pmod(F.xxhash64("form"), F.lit(_SALTS)).cast("int")))
    masks = (new.select(F.col(KEY), F.explode("kept").alias("k")).select(KEY, F.col("k.masked").alias("masked"))
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))))
    return _join(behind, masks, ["masked", "_salt"], "left_anti").select(rest.columns)


def _join(rows: DataFrame, table: DataFrame, also: list[str], how: str) -> DataFrame:
    """Join on the session, NULL being one of its values, and other columns."""
    table = table.withColumnsRenamed({KEY: "_session", **{c: f"_same_{c}" for c in also}})
    same = F.col(KEY).eqNullSafe(F.col("_session"))
    for c in also:
        same = same & (F.col(c) == F.col(f"_same_{c}"))
    return rows.join(table, same, how).drop("_session", *[f"_same_{c}" for c in also])


def mark_duplicates(steps: DataFrame, threshold: float = DUPLICATE_SIMILARITY,
                    block: int = BLOCK_FORMS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """SQL calls with ``idx`` and ``is_duplicate``; an empty normal form is never
    a duplicate. The join is on session and position, so a long session spreads."""
    calls = sql_calls(steps, chunk_rows)
    kept = kept_calls(_sql_steps(steps), threshold, block).withColumn("_kept", F.lit(True))
    return (_join(calls, kept, [POSITION], "left")
            .withColumn("is_duplicate", F.col("_kept").isNull() & (S.normalize(F.col("sql")) != ""))
            .drop("_kept"))


def duplicate_counts(steps: DataFrame, threshold: float = DUPLICATE_SIMILARITY,
                     block: int = BLOCK_FORMS) -> DataFrame:
    """Per session with SQL calls: calls, duplicates, and their share."""
    calls = _sql_steps(steps)
    kept = kept_calls(calls, threshold, block).groupBy(KEY).agg(F.count("*").alias("n_kept"))
    seen = calls.groupBy(KEY).agg(
        F.count("*").alias("n_sql_calls"),
        F.count_if(S.normalize(F.col("sql")) != "").alias("n_forms"))
    both = _join(seen, kept, [], "left")
    dups = F.col("n_forms") - F.coalesce("n_kept", F.lit(0))
    return both.select(KEY, "n_sql_calls", dups.alias("duplicate_sql_count"),
                       F.try_divide(dups, "n_sql_calls").alias("redundant_query_rate"))


def recovery_pairs(steps: DataFrame, min_similarity: float = RECOVERY_SIMILARITY,
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Genuine repairs: a failed SQL call directly followed by a successful one
    whose masked normal form is similar. One row per pair, by call index."""
    calls = previous(sql_calls(steps, chunk_rows), KEY, POSITION, ["sql", "ok"], chunk_rows=chunk_rows)
    tried = calls.filter((F.col("prev_ok") == F.lit(False)) & F.col("ok"))
    forms = tried.withColumns({"_a": S.normalize(F.col("prev_sql"), mask=True),
                               "_b": S.normalize(F.col("sql"), mask=True)})
    pairs = forms.withColumn("similarity", M.form_similarity(F.col("_a"), F.col("_b"), min_similarity))
    return pairs.filter(F.col("similarity") >= min_similarity).select(
        KEY, (F.col("idx") - 1).alias("failed_idx"), F.col("idx").alias("fixed_idx"), "similarity")


def char_length(messages: Column) -> Column:
    """Characters of a session's messages (``array<struct<role,content>>``)."""
    return F.aggregate(messages, F.lit(0).cast("bigint"),
                       lambda n, m: n + F.length(F.coalesce(m["content"], F.lit(""))))


def session_stats(steps: DataFrame, budget: Budget = Budget(),
                  threshold: float = DUPLICATE_SIMILARITY,
                  min_similarity: float = RECOVERY_SIMILARITY) -> DataFrame:
    """The stats record of every session (rate to 4 decimals)."""
    # The SQL calls are needed three times: they are written, the log is read twice.
    calls = cut_lineage(_sql_steps(steps).select(KEY, POSITION, "tool_name", "sql", "ok", "error", "error_type"))
    dups = duplicate_counts(calls, threshold).drop("n_sql_calls")
    fixed = recovery_pairs(calls, min_similarity).groupBy(KEY).agg(F.count("*").alias("recovery_count"))
    out = _join(_join(budget_flags(session_counts(steps), budget), dups, [], "left"), fixed, [], "left")
    return out.withColumns({
        "duplicate_sql_count": F.coalesce("duplicate_sql_count", F.lit(0)),
        "recovery_count": F.coalesce("recovery_count", F.lit(0)),
        "redundant_query_rate": F.bround(F.coalesce("redundant_query_rate", F.lit(0.0)), 4),
    })


def replay_budget(turns: DataFrame, budget: Budget = Budget(), chars: str = "chars",
                  terminal: str = "terminal") -> DataFrame:
    """Which turn stops a session under a budget, and why.

    ``chars`` is what a turn adds to the conversation, ``terminal`` marks an
    accepted final answer. A call beyond its limit is blocked (and ends the run
    with ``force_finish``); the third turn without a call ends it; an answer ends
    it; too many characters end it after a carried-out call; else the turns run
    out, or the log ends before that (``log_end``). Only the first ``max_turns`` turns can matter, so the ranking keeps that
    many rows per session before anything is shuffled.
    """
    order = Window.partitionBy(KEY).orderBy(POSITION)
    head = (turns.withColumn("turn_no", F.row_number().over(order))
            .filter(F.col("turn_no") <= budget.max_turns))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tool = F.col("tool_name")
    ranked = head.withColumns({
        "_sql": F.count_if(tool.eqNullSafe(SQL_TOOL)).over(so_far),
        "_ctx": F.count_if(tool.eqNullSafe(CONTEXT_TOOL)).over(so_far),
        "_idle": F.count_if(tool.isNull()).over(so_far),
        "_chars": F.sum(chars).over(so_far),
    })
    sql_blocked = tool.eqNullSafe(SQL_TOOL) & (F.col("_sql") > budget.max_sql_calls)
    ctx_blocked = tool.eqNullSafe(CONTEXT_TOOL) & (F.col("_ctx") > budget.max_context_calls)
    stops = F.lit(budget.force_finish)
    reason = (
        F.when(tool.isNull(), F.when(F.col("_idle") >= budget.turns_without_call, "no_tool_call"))
        .when(sql_blocked, F.when(stops, "max_sql_calls"))
        .when(ctx_blocked, F.when(stops, "max_context_calls"))
        .when(F.col(terminal), F.lit("final_answer"))
        .when(F.col("_chars") > budget.max_chars, F.lit("budget_chars"))
    )
    judged = ranked.withColumn("_reason", reason)
    stop = F.struct(POSITION, "turn_no", F.col("_reason").alias("reason"))
    first = judged.groupBy(KEY).agg(
        F.min(F.when(F.col("_reason").isNotNull(), stop)).alias("stop"),
        F.max(F.struct(POSITION, "turn_no")).alias("last"))
    return first.select(
        KEY, F.coalesce("stop.turn", "last.turn").alias("stop_turn"),
        F.coalesce("stop.turn_no", "last.turn_no").cast("bigint").alias("n_turns"),
        F.coalesce("stop.reason", F.when(F.col("last.turn_no") >= budget.max_turns, "max_turns").otherwise(
            "log_end")).alias("reason"))
