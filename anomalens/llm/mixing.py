"""Mix sources to target weights by fitting budgets in whole documents.

The documents of each source are counted by exact length. A source takes whole
passes over its documents as often as the target allows; of the rest every length
gives its share, and a bounded knapsack over the lengths (reachable sums as the bits
of one integer) closes what remains. Where that misses the target, shares are taken
back step by step, up to ``KNAPSACK_WORDS`` words, and given to the knapsack: a rest of
at most that many words is closed by the nearest sum there is, a larger one by the
nearest sum found. Within a length a seeded hash says which documents are taken.

Defined cases: a null text has no words, documents without words are never taken;
null is a source of its own, last in order; a source none of whose lengths fits its
rest takes the nearest sum it can reach; no document is taken more than
``max_repeats`` times; equal rows are interchangeable; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from anomalens.llm.common import numbered, packed, text_of, unpacked, word_count
from anomalens.plans.storage import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
# Words that the knapsack closes; shares and whole documents bring a larger rest below it.
KNAPSACK_WORDS = 65_536
CHUNK_ROWS = 20_000


def targets_of(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS,
               max_repeats: float = MAX_REPEATS) -> dict[str | None, float]:
    """Words per source: the total by weight, weights repeating over the sources in
    code point order with null last. What a source cannot take (``max_repeats``
    times its size) is shared anew by weight among the others, until nothing is."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), list(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > max_repeats * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = float(max_repeats * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, target: float, max_repeats: int = MAX_REPEATS,
                window: int = KNAPSACK_WORDS) -> tuple[int, np.ndarray]:
    """Whole passes, and how many documents of each length are taken once more."""
    total = int((lengths * counts).sum())
    extra = np.zeros(len(lengths), np.int64)
    if total == 0:
        return 0, extra
    passes = min(max_repeats, int(target // total))
    exact = target - passes * total
    if passes == max_repeats or round(exact) <= 0:
        return passes, extra
    best = None
    for back in (0, window // 64, window // 8, window):
        extra = _fit(lengths, counts, exact, max(0.0, exact - back) / total, window)
        error = abs(int((lengths * extra).sum()) - exact)
        if best is None or error < best[0]:
            best = error, extra
        if error <= 0.5 or back >= exact:
            break
    return passes, best[1]


def _fit(lengths: np.ndarray, counts: np.ndarray, exact: float, share: float, window: int) -> np.ndarray:
    """``share`` of the documents of each length, and the knapsack for the rest."""
    extra = np.minimum(np.floor(counts * share).astype(np.int64), counts)
    extra[lengths == 0] = 0
    rest = exact - int((lengths * extra).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if rest > window and 0 < lengths[i] <= rest:
            more = min(int(counts[i] - extra[i]), max(0, math.ceil((rest - window) / int(lengths[i]))))
            more = min(more, int(rest // int(lengths[i])))
            extra[i] += more
            rest -= more * int(lengths[i])
    return extra + _knapsack(lengths, counts - extra, rest, window)


def _knapsack(lengths: np.ndarray, left: np.ndarray, exact: float, window: int) -> np.ndarray:
    """The documents whose lengths sum up nearest to ``exact``; of two the lesser sum."""
    chosen = np.zeros(len(lengths), np.int64)
    rest = max(0, round(exact))
    steps: list[tuple[int, int, int]] = []  # length index, documents, sums reachable before
    reach, limit = 1, (1 << (2 * rest + 1)) - 1  # a sum beyond twice the rest is no nearer than none
    if rest <= window:
        for i in np.argsort(lengths, kind="stable"):
            size, many, lot = int(lengths[i]), int(left[i]), 1
            if size == 0 or size > 2 * rest:
                continue
            many = min(many, 2 * rest // size)
            while many and not reach >> rest & 1:
                take = min(lot, many)
                steps.append((i, take, reach))
                reach |= (reach << take * size) & limit
                many, lot = many - take, lot * 2
            if reach >> rest & 1:
                break
    below = (reach & ((2 << rest) - 1)).bit_length() - 1
    above = reach >> rest
    above = rest + (above & -above).bit_length() - 1 if above else None
    goal = above if above is not None and above - exact < exact - below else below
    # Beyond the window one document may be nearer than none.
    single = [(abs(int(n) - exact), i) for i, n in enumerate(lengths) if rest > window and left[i] > 0 and n > 0]
    if single and min(single)[0] < abs(goal - exact):
        chosen[min(single)[1]] = 1
        return chosen
    for i, take, before in reversed(steps):
        if not before >> goal & 1:
            chosen[i] += take
            goal -= take * int(lengths[i])
    return chosen


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", size: Column | None = None,
        weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 7,
        chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``size`` (words; or a given column), ``source_size``, ``target`` and
    ``repeats`` (how often the mix takes the document).

    The driver sees one row per source. A length that many documents share is ranked
    in chunks of ``chunk_rows``.
    """
    rows = packed(docs, s=F.coalesce(F.col(source), F.lit("")), none=F.col(source).isNull(),
                  n=word_count(text_of(text)) if size is None else size.cast("bigint"),
                  h=F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.lit("mix")), k=F.col(key).cast("string"))
    counted = cut_lineage(rows.groupBy("s", "none", "n").agg(F.count("*").alias("c")))
    sums = counted.groupBy("s", "none").agg(F.sum(F.col("n") * F.col("c")).alias("t")).collect()
    sizes = {None if r.none else r.s: int(r.t) for r in sums}
    targets = targets_of(sizes, weights, max_repeats)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        name = None if pdf["none"].iloc[0] else pdf["s"].iloc[0]
        pdf = pdf.sort_values("n")
        passes, extra = fit_lengths(pdf["n"].to_numpy(), pdf["c"].to_numpy(), targets[name], max_repeats)
        return pdf.assign(passes=passes, extra=extra, source_size=sizes[name], target=targets[name])

    plan = cut_lineage(counted.groupBy("s", "none").applyInPandas(
        fit, "s string, none boolean, n bigint, c bigint, passes bigint, extra bigint, source_size bigint, "
             "target double"))
    largest = plan.agg(F.max("c")).first()[0] or 0
    rows = rows.join(plan, ["s", "none", "n"])
    chunk = F.pmod(F.xxhash64("h"), F.ceil(F.col("c") / F.lit(chunk_rows)))
    rows = numbered(rows, ["s", "none", "n"], chunk, [F.col("h"), F.col("k")], "place", chunks=largest > chunk_rows)
    repeats = F.col("passes") + F.when(F.col("place") < F.col("extra"), 1).otherwise(0)
    return unpacked(rows, size=F.col("n"), source_size=F.col("source_size"), target=F.col("target"),
                    repeats=F.when(F.col("n") == 0, F.lit(0)).otherwise(repeats).cast("int"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *{
        c: F.col(c).alias(c) for c in (text, source, key)}.values())
    rows = mix(rows, text, source, key, **options).filter("repeats > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("doc.*")
