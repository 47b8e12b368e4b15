"""Mixed Latin / CJK tokens of a text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_WORD = r"(?U)[a-zA-Z_][a-zA-Z0-9_]*|\d+"
_CJK = "[一-鿿]"


def tokenize(text: Column) -> Column:
    """Words and digit runs, then bigrams over all CJK characters joined (also
    across gaps), then the CJK characters themselves."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))
    cjk = F.regexp_extract_all(low, F.lit(_CJK), F.lit(0))
    follow = F.slice(cjk, 2, F.greatest(F.size(cjk) - 1, F.lit(0)))
    bigrams = F.filter(F.zip_with(cjk, follow, lambda a, b: F.concat(a, b)),
                       lambda x: x.isNotNull())
    return F.when(low.rlike(_CJK), F.concat(words, bigrams, cjk)).otherwise(words)
