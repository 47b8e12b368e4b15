"""Sequence similarity of texts.

Spark has no expression for the Ratcliff/Obershelp ratio, so the comparison
itself is a small Arrow UDF over the standard library. Everything that can be
decided without it (empty, equal, containment, length bound) is decided in
native expressions first, and the UDF sees NULL for those rows.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from anomalens.functions.sqltext import normalize, strip

_CACHED_CHARS = 20_000_000


class _Compare:
    """Comparison of two texts inside a task. Argument order matters. Query
    templates repeat a lot, so the answers to a bounded number of characters are
    kept."""

    def __init__(self) -> None:
        self._answers: dict[tuple, float | bool] = {}
        self._chars = 0

    def _cached(self, key: tuple, compute) -> float | bool:
        if key not in self._answers:
            self._chars += len(key[0]) + len(key[1])
            if self._chars > _CACHED_CHARS:
                self._answers.clear()
                self._chars = len(key[0]) + len(key[1])
            self._answers[key] = compute()
        return self._answers[key]

    def ratio(self, a: str, b: str) -> float:
        if a == b:
            return 1.0
        if not a or not b:
            return 0.0
        return self._cached((a, b), lambda: SequenceMatcher(None, a, b).ratio())

    def at_least(self, a: str, b: str, threshold: float) -> bool:
        """``ratio(a, b) >= threshold``, with the cheap upper bounds tried first."""
        if 2.0 * min(len(a), len(b)) < threshold * (len(a) + len(b)):
            return False

        def compute() -> bool:
            m = SequenceMatcher(None, a, b)
            return m.quick_ratio() >= threshold and m.ratio() >= threshold

        return self._cached((a, b, threshold), compute)


def _coded(texts: pa.Array) -> tuple[np.ndarray, list[str | None]]:
    """Texts as numbers: each one's place in the list of distinct ones, -1 (where the
    list has None) for NULL."""
    coded = texts.dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32), [*coded.dictionary.to_pylist(), None]


def _ends(lists: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))])


@F.arrow_udf(T.DoubleType())
def _ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Equal pairs of a batch are compared once."""
    compare = _Compare()
    (left, texts), (right, others) = _coded(a), _coded(b)
    pairs, place = np.unique(np.stack([left, right]), axis=1, return_inverse=True)
    answers = [None if i < 0 or j < 0 else compare.ratio(texts[i], others[j]) for i, j in pairs.T.tolist()]
    return pa.array(answers, pa.float64()).take(pa.array(place.reshape(-1)))


def _decide(a: Column, b: Column, known: Column) -> Column:
    """``known`` where it is not NULL, the ratio elsewhere."""
    blank = F.lit(None).cast("string")
    open_a = F.when(known.isNull(), a).otherwise(blank)
    return F.coalesce(known, _ratio.asNondeterministic()(open_a, b))


def form_similarity(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Similarity of two normal forms. Pairs that cannot reach ``floor`` by their
    lengths alone are reported as 0 without a comparison."""
    la, lb = F.length(a), F.length(b)
    known = (
        F.when(a == b, F.lit(1.0))
        .when((a == "") | (b == ""), F.lit(0.0))
    )
    if floor > 0:
        known = known.when(2.0 * F.least(la, lb) < F.lit(floor) * (la + lb), F.lit(0.0))
    return _decide(a, b, known)


def sql_similarity(a: Column, b: Column, mask: bool = False) -> Column:
    """Similarity (0 to 1) of two SQL texts after normalising."""
    return form_similarity(normalize(a, mask), normalize(b, mask))


def clean(text: Column) -> Column:
    return F.lower(strip(F.coalesce(text, F.lit(""))))


def contains_match(p: Column, g: Column) -> Column:
    """1 if either clean text contains the other, 0 if one is empty, else NULL. Both
    stand in the expression several times, so hand in columns that are worked out."""
    return (
        F.when((p == "") | (g == ""), F.lit(0.0))
        .when(F.contains(p, g) | F.contains(g, p), F.lit(1.0))
    )


def clean_match(p: Column, g: Column) -> Column:
    """``text_match`` of texts that are clean already."""
    return _decide(p, g, contains_match(p, g))


def text_match(pred: Column, gold: Column) -> Column:
    """1 if either text contains the other, else the ratio; 0 if one is empty."""
    return clean_match(clean(pred), clean(gold))


class _Near:
    """Texts that may reach a ratio with another one, without comparing all.

    A ratio of t leaves at most ``(1 - t) * (la + lb)`` characters of both texts
    unmatched. A text is cut into one segment more than that, so one segment stands
    unchanged in any text that is close enough, shifted by no more than that. Segments
    are looked up at those places; nothing that could reach the ratio is missed.
    """

    _FEW = 24

    def __init__(self, threshold: float) -> None:
        self._t = threshold
        self._texts: list[str] = []
        self._lengths: dict[int, tuple[int, list[int], list[dict[str, list[int]]]]] = {}

    def _unmatched(self, a: int, b: int) -> int:
        return int((1.0 - self._t) * (a + b) + 1e-6)

    def add(self, text: str) -> None:
        self._texts.append(text)
        if len(self._texts) == self._FEW + 1:  # few texts are not looked up, so not cut
            for i, t in enumerate(self._texts):
                self._index(i, t)
        elif len(self._texts) > self._FEW:
            self._index(len(self._texts) - 1, text)

    def _index(self, place: int, text: str) -> None:
        n = len(text)
        if n not in self._lengths:
            longest = int(n * (2.0 - self._t) / self._t) + 1
            parts = min(n, self._unmatched(longest, n) + 1)
            cuts = [n * i // parts for i in range(parts + 1)]
            self._lengths[n] = parts, cuts, [{} for _ in range(parts)]
        _, cuts, segments = self._lengths[n]
        for i, found in enumerate(segments):
            found.setdefault(text[cuts[i]:cuts[i + 1]], []).append(place)

    def candidates(self, text: str):
        if len(self._texts) <= self._FEW:
            yield from self._texts
            return
        n, tried = len(text), set()
        for m, (parts, cuts, segments) in self._lengths.items():
            if 2.0 * min(m, n) < self._t * (m + n):
                continue
            shift = self._unmatched(m, n)
            # Too short to be cut that often: every text of that length.
            whole = parts <= shift
            for i, found in enumerate(segments):
                low, size = cuts[i], cuts[i + 1] - cuts[i]
                hits = found.values() if whole else (
                    found[s] for p in range(max(0, low - shift), min(n - size, low + shift) + 1)
                    if (s := text[p:p + size]) in found)
                for some in hits:
                    for k in some:
                        if k not in tried:
                            tried.add(k)
                            yield self._texts[k]


def _walk(compare: _Compare, texts, masks, dropped, threshold: float) -> list[bool]:
    """Which forms of an ordered list are kept when a form that is empty, known to
    be dropped, close to an earlier kept one, or equal to one under the number
    mask is dropped."""
    kept = _Near(threshold)
    seen: set[str] = set()
    flags = []
    for text, mask, gone in zip(texts, masks, dropped):
        new = (text != "" and not gone and mask not in seen
               and not any(compare.at_least(text, k, threshold) for k in kept.candidates(text)))
        if new:
            kept.add(text)
            seen.add(mask)
        flags.append(new)
    return flags


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _kept_forms(forms: pd.Series, masked: pd.Series, dropped: pd.Series,
                threshold: pd.Series) -> pd.Series:
    compare = _Compare()
    return pd.Series([_walk(compare, *row) for row in zip(forms, masked, dropped, threshold)])


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _close_to_any(forms: pd.Series, kept: pd.Series, threshold: pd.Series) -> pd.Series:
    """For each form of the first list: is it close to any form of the second?"""
    compare, out = _Compare(), []
    for some, known, t in zip(forms, kept, threshold):
        near = _Near(t)
        for k in known:
            near.add(k)
        out.append([any(compare.at_least(f, k, t) for k in near.candidates(f)) for f in some])
    return pd.Series(out)


_SESSION = T.StructType([
    T.StructField("kept", T.ArrayType(T.BooleanType())),
    T.StructField("repair", T.ArrayType(T.DoubleType())),
    T.StructField("best", T.ArrayType(T.StructType([
        T.StructField("idx", T.IntegerType()), T.StructField("sim", T.DoubleType())]))),
])


_ANSWER = pa.struct([("kept", pa.list_(pa.bool_())), ("repair", pa.list_(pa.float64())),
                     ("best", pa.list_(pa.struct([("idx", pa.int32()), ("sim", pa.float64())])))])


@F.arrow_udf(_SESSION)
def _session(forms: pa.Array, masked: pa.Array, repairs: pa.Array, evidence: pa.Array,
             threshold: pa.Array) -> pa.Array:
    """All comparisons a session record needs, in one trip to Python: kept forms;
    similarity of each marked call to the one before it; and for each evidence
    form the first most similar call (idx -1 if none is above 0). Records of a batch
    that are equal in all of this are compared once; they are told apart by the numbers
    of their texts."""
    compare = _Compare()

    def best(form, given):
        idx, sim = -1, 0.0
        for i, g in enumerate(given if form is not None else ()):
            if form != g and 2.0 * min(len(form), len(g)) <= sim * (len(form) + len(g)):
                continue
            score = compare.ratio(form, g)
            if score > sim:
                idx, sim = i, score
        return {"idx": idx, "sim": sim}

    def answer(fs, ms, marks, wanted, t):
        return {"kept": _walk(compare, fs, ms, [False] * len(fs), t),
                "repair": [compare.ratio(ms[i - 1], ms[i]) if marked else None for i, marked in enumerate(marks)],
                "best": [best(w, fs) for w in wanted]}

    coded = [_coded(c.flatten()) for c in (forms, masked, evidence)]
    columns = [codes for codes, _ in coded] + [repairs.flatten().fill_null(False).to_numpy(zero_copy_only=False)]
    ends = [_ends(c).tolist() for c in (forms, masked, evidence, repairs)]
    limits = threshold.to_pylist()
    known: dict[tuple, int] = {}
    answers, place = [], []
    for i, t in enumerate(limits):
        parts = [c[e[i]:e[i + 1]] for c, e in zip(columns, ends)]
        key = (*(p.tobytes() for p in parts), t)
        at = known.get(key)
        if at is None:
            at = known[key] = len(answers)
            fs, ms, wanted = ([words[j] for j in p.tolist()] for p, (_, words) in zip(parts, coded))
            answers.append(answer(fs, ms, parts[3].tolist(), wanted, t))
        place.append(at)
    return pa.array(answers, _ANSWER).take(pa.array(place, pa.int32()))


# Marked so that no later filter is pushed below them and makes them run twice.
kept_forms = _kept_forms.asNondeterministic()
close_to_any = _close_to_any.asNondeterministic()
session_comparisons = _session.asNondeterministic()
