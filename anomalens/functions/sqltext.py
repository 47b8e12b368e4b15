"""Column functions over SQL text: noise removal, legality checks, normal form.

All of them are built-in expressions (no Python per row). Patterns use the
``(?U)`` flag because ``\\s``, ``\\b`` and ``\\d`` must follow Unicode, and the
quoted-literal patterns are possessive: a plain alternation under ``*`` recurses
once per character in Java and overflows the stack on a long literal.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from anomalens.config import ALLOWED_STATEMENTS, FORBIDDEN_FUNCTIONS, FORBIDDEN_KEYWORDS

# Unicode white space as text tools outside the JVM see it (adds the four separators).
_WS = r"[\s\x1c-\x1f]"
_DOLLAR = r"(?s)\$\$.*?\$\$"
_BLOCK_COMMENT = r"(?s)/\*.*?\*/"
_LINE_COMMENT = r"--[^\n]*"
_NUMBER = r"(?U)\b\d+(?:\.\d+)?\b"


def _quoted(q: str) -> str:
    """A closed literal with doubled quotes inside; for a literal that never
    closes, the text up to its last doubled quote."""
    run = f"[^{q}]*+"
    tail = f"{run}\\z"
    closed = f"{q}{run}(?:{q}{q}{run})*+{q}"
    broken = f"{q}{run}(?:{q}{q}(?!{tail}){run})*+{q}(?={q}{tail})"
    return f"{closed}|{broken}"


_SINGLE = _quoted("'")
_DOUBLE = _quoted('"')


def literal(word: str) -> str:
    """A word as a pattern that matches just itself."""
    return rf"\Q{word}\E"


def strip(c: Column) -> Column:
    """Trim Unicode white space (``F.trim`` knows only U+0020)."""
    return F.regexp_replace(c, rf"(?U)^{_WS}+|{_WS}+\z", "")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"(?U){_WS}+", " "))


def strip_noise(sql: Column, strict: bool = False) -> Column:
    """Blank out dollar quotes, comments, string literals and quoted names.

    The default removes line comments before string literals, so ``--`` inside a
    literal hides the rest of the line. ``strict`` removes literals first.
    """
    steps = [(_DOLLAR, "''"), (_BLOCK_COMMENT, " "), (_LINE_COMMENT, " "),
             (_SINGLE, "''"), (_DOUBLE, '""')]
    if strict:
        steps = [steps[0], *steps[3:], *steps[1:3]]
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, sql)


def statements_of(body: Column) -> Column:
    """Non-empty statements of a text that already had its noise removed."""
    parts = F.transform(F.split(body, ";"), strip)
    return F.filter(parts, lambda p: p != "")


def split_statements(sql: Column, strict: bool = False) -> Column:
    return statements_of(strip_noise(sql, strict))


def keyword_of(body: Column) -> Column:
    word = F.regexp_extract(body, rf"^(?U:{_WS}*)[( \t\r\n]*([A-Za-z_][A-Za-z0-9_]*)", 1)
    return F.upper(word)


def first_keyword(sql: Column, strict: bool = False) -> Column:
    return keyword_of(strip_noise(sql, strict))


def _first_hit(body: Column, words: Sequence[str], after: str) -> Column:
    """First word of the list (in list order) that occurs; NULL if none does. The text
    is scanned once for all words; what is found is looked up in the list."""
    found = F.regexp_extract_all(body, F.lit(rf"(?iU)\b({'|'.join(literal(w) for w in words)}){after}"), F.lit(1))
    # The letters that equal ASCII ones when case is ignored become these.
    plain = F.array(*[F.lit(w.lower()) for w in words])
    places = F.transform(found, lambda w: F.array_position(plain, F.lower(F.upper(F.translate(w, "İ", "I")))))
    return F.get(F.array(*[F.lit(w) for w in words]), F.array_min(places).cast("int") - 1)


def keyword_hit(body: Column, words: Sequence[str] = FORBIDDEN_KEYWORDS) -> Column:
    return _first_hit(body, words, r"\b")


def function_hit(body: Column, names: Sequence[str] = FORBIDDEN_FUNCTIONS) -> Column:
    return _first_hit(body, names, r"(?:\s|[\x1c-\x1f])*\(")


def find_forbidden(sql: Column, words: Sequence[str] = FORBIDDEN_KEYWORDS,
                   strict: bool = False) -> Column:
    return keyword_hit(strip_noise(sql, strict), words)


def find_forbidden_function(sql: Column, names: Sequence[str] = FORBIDDEN_FUNCTIONS,
                            strict: bool = False) -> Column:
    return function_hit(strip_noise(sql, strict), names)


def verdict_of(sql: Column, body: Column,
               allowed: Sequence[str] = ALLOWED_STATEMENTS,
               words: Sequence[str] = FORBIDDEN_KEYWORDS,
               names: Sequence[str] = FORBIDDEN_FUNCTIONS) -> Column:
    """``struct(verdict, hit)``: the first rule that fails decides."""
    count = F.size(statements_of(body))
    kind, word, func = keyword_of(body), keyword_hit(body, words), function_hit(body, names)

    def result(name: str, hit: Column) -> Column:
        return F.struct(F.lit(name).alias("verdict"), hit.cast("string").alias("hit"))

    none = F.lit(None).cast("string")
    return (
        F.when(sql.isNull() | (strip(sql) == ""), result("empty", none))
        .when(count > 1, result("multi_statement", count))
        .when(~kind.isin(*allowed),
              result("kind_not_allowed", F.coalesce(F.nullif(kind, F.lit("")), F.lit("UNKNOWN"))))
        .when(word.isNotNull(), result("banned_keyword", word))
        .when(func.isNotNull(), result("banned_function", func))
        .otherwise(result("ok", none))
    )


def mask_numbers(normal: Column) -> Column:
    return F.regexp_replace(normal, _NUMBER, "?")


def normalize(sql: Column, mask: bool = False) -> Column:
    """Comparable form: no noise, lower case, single blanks, no edge ``;``,
    tight commas and brackets; numbers become ``?`` with ``mask``."""
    flat = collapse_spaces(F.lower(strip_noise(sql)))
    bare = F.trim(F.regexp_replace(flat, r"^;+|;+\z", ""))
    if mask:
        bare = mask_numbers(bare)
    tight = F.regexp_replace(bare, " ?, ?", ",")
    return F.regexp_replace(F.regexp_replace(tight, r"\( ?", "("), r" ?\)", ")")


# The steps of ``normalize``: the pattern, what replaces it, and texts of which a text
# that the step changes has one.
_NOISE_STEPS = ((_DOLLAR, "''", ("$$",)), (_BLOCK_COMMENT, " ", ("/*",)), (_LINE_COMMENT, " ", ("--",)),
                (_SINGLE, "''", ("'",)), (_DOUBLE, '""', ('"',)))
_TIGHT_STEPS = ((" ?, ?", ",", (" ,", ", ")), (r"\( ?", "(", ("( ",)), (r" ?\)", ")", (" )",)))


def normalize_all(texts: Column) -> Column:
    """``normalize`` of every text of a list. Each step is one pass over the list, so a
    text that has nothing for a pattern to find is not scanned by it."""
    def passed(c: Column, pattern: str, by: str, marks: Sequence[str]) -> Column:
        found = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(m)) for m in marks])
        return F.transform(c, lambda x: F.when(found(x), F.regexp_replace(x, pattern, by)).otherwise(x))
    plain = reduce(lambda c, step: passed(c, *step), _NOISE_STEPS, texts)
    flat = F.transform(plain, lambda x: collapse_spaces(F.lower(x)))
    bare = F.transform(passed(flat, r"^;+|;+\z", "", (";",)), lambda x: F.trim(x))
    return reduce(lambda c, step: passed(c, *step), _TIGHT_STEPS, bare)
