"""Quality rules: a table of thresholds compiled into one projection.

A rule bounds the ratio of two counts of a text, in percent. The counts (words, their
code points, symbols, stop words, lines, repeated lines and word windows) are column
expressions over the whole text, and the verdict is one more expression over them, so
the operator is a narrow stage: no shuffle, no Python.

Words are runs of anything but the ASCII blanks. A window is ``WINDOW`` words in a row;
windows are sorted inside the row and equal neighbours are repeats, so a text of n
words costs n log n. All ratios are compared as whole numbers, so no rounding decides.

Defined cases: a null text counts as empty; a text without words fails the base rules
and is not kept; a ratio whose denominator is 0 breaks no rule; repeated rows and null
keys are judged like any other row, as rows never meet; an empty table gives an empty
result; an input column with the name of an added one (in any case) gives way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from anomalens.llm.common import packed, text_of, unpacked

LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
SYMBOLS, MARKS = "#*$%&|<>", "!?"

# Inside a character class.
_BLANK = r"\x20\x09-\x0D"

# An array has at most 2^31 elements.
_PLACE_BITS = 31

# Frequent function words of English, German, French and Spanish; matched as running
# text has them, in lower case and without punctuation.
STOP_WORDS = tuple(dict.fromkeys(
    "the of and to a in is that it for was on with as be by this are at from "
    "der die und den von das mit sich des ist im dem nicht ein eine als auch auf für zu "
    "de le la et les des un une est pas que qui dans pour par sur en du plus "
    "el los las y del se con una por para su al lo como más o".split()))


@dataclass(frozen=True)
class Rule:
    """``least`` <= 100 * count / of <= ``most``; a bound may be missing."""

    name: str
    count: str
    of: str
    least: int | None = None
    most: int | None = None

    def broken(self, counts: Callable[[str], Column]) -> Column:
        value, whole = 100 * counts(self.count), counts(self.of)
        out = F.lit(False)
        if self.least is not None:
            out = out | (value < self.least * whole)
        if self.most is not None:
            out = out | (value > self.most * whole)
        return out


RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("marks", "n_marks", "n_words", most=50),
    Rule("stop_words", "n_stop_words", "n_words", least=5),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=90),
    Rule("open_lines", "n_open_lines", "n_lines", most=30),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once, inside the same expression."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{_BLANK}]+"), lambda w: w != "")


def _count(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{chars}]")).cast("bigint")


def _size(array: Column) -> Column:
    return F.size(array).cast("bigint")


def _with_equal_neighbour(rows: Column, value: Callable[[Column], Column]) -> Column:
    """Of a sorted array the elements whose value the one before or after has, too."""
    def same(x: Column, other: Column) -> Column:  # null beyond either end
        return F.coalesce(value(x) == value(other), F.lit(False))
    return F.filter(rows, lambda x, i: same(x, F.get(rows, i - 1)) | same(x, F.get(rows, i + 1)))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in a window that the array holds twice or more.

    One sort of (33 bits of a hash, position) in a long each leaves the windows that
    may repeat; only those are written out and compared."""
    def marks(w: Column) -> Column:
        last = F.size(w) - window
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.sort_array(F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)])
                                        .bitwiseAND(F.lit(-1 << _PLACE_BITS)).bitwiseOR(i)))

    def written(w: Column, likely: Column) -> Column:
        places = F.transform(likely, lambda m: m.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int"))
        return F.array_sort(F.transform(places, lambda i: F.struct(
            F.array_join(F.slice(w, i + 1, window), " ").alias("w"), i.alias("i"))))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.lit(window), p - F.coalesce(F.get(at, j - 1), F.lit(-window))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b).cast("bigint")

    return _let(marks(words), lambda m: _let(
        written(words, _with_equal_neighbour(m, lambda x: F.shiftright(x, _PLACE_BITS))), lambda s: _let(
            F.array_sort(F.transform(_with_equal_neighbour(s, lambda x: x["w"]), lambda x: x["i"])), covered)))


def counts_of(text: Column) -> Column:
    """All counts of a text as one struct."""
    def over(words: Column, lines: Column) -> Column:
        return F.struct(
            _size(words).alias("n_words"),
            (F.char_length(text) - _count(text, _BLANK)).cast("bigint").alias("word_chars"),
            _count(text, SYMBOLS).alias("n_symbols"),
            _count(text, MARKS).alias("n_marks"),
            _size(F.filter(words, lambda w: w.isin(*STOP_WORDS))).alias("n_stop_words"),
            _size(lines).alias("n_lines"),
            (_size(lines) - _size(F.array_distinct(lines))).alias("n_dup_lines"),
            _size(F.filter(lines, lambda x: x.rlike(f"^[{_BLANK}]*[-*•]"))).alias("n_bullet_lines"),
            _size(F.filter(lines, lambda x: x.rlike(f"(\\.\\.\\.|…)[{_BLANK}]*$"))).alias("n_open_lines"),
            repeated_words(words).alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{_BLANK}]"))
    return _let(words_of(text), lambda w: _let(lines, lambda n: over(w, n)))


def verdict(counts: Callable[[str], Column], rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """(whether the base rules fail, the names of the table's broken rules)."""
    base = (counts("n_words") < LEAST_WORDS) | (100 * counts("n_repeat_words") > MOST_REPEATED * counts("n_words"))
    names = F.array(*[F.when(r.broken(counts), F.lit(r.name)) for r in rules]) if rules else F.array().cast("array<string>")
    return base, F.array_compact(names)


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows with their counts, ``base_failed``, ``broken`` (names of the broken
    rules) and ``kept``."""
    rows = packed(docs, counts=counts_of(text_of(f"`{text}`")))

    def counts(name: str) -> Column:
        return F.col(f"counts.{name}")
    base, broken = verdict(counts, rules)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_stop_words", "n_lines",
             "n_bullet_lines", "n_open_lines")
    return unpacked(rows, **{n: counts(n) for n in names}, base_failed=base, broken=broken,
                    kept=~base & (F.size(broken) == 0))
