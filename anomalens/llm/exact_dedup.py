"""Exact duplicates with a two-pass Bloom filter, in DataFrame operations only.

Pass 1 sets two bits per text in one 64-bit word of a blocked filter and keeps the
bits that were set more than once. Pass 2 looks every text up: if one of its bits
was set once only, no other text equals it, and its row passes straight through.
Only the other rows are shuffled and compared, by the SHA-256 of the text.

The filter has 16 bits per row and stays a table; only 64-bit hashes go to it, and its
answer is the short list of hashes that may repeat. Rows are joined with that list, not
with the filter: up to ``BROADCAST_HASHES`` (counted first) it is broadcast and no row
moves; a longer list is a join on the hash, in which rows move once.

Defined cases: a null text counts as empty; texts are equal if they are identical
once A-Z are lower-cased; of equal texts the row with the largest key stays, null
being the smallest key; of rows that agree in key and text exactly one stays; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from anomalens.llm.common import lower_ascii, packed, text_of, unpacked
from anomalens.plans.storage import cut_lineage

ROWS_PER_WORD = 4
# 64-bit hashes; some 64 MB as a hash table.
BROADCAST_HASHES = 4_000_000


def text_digest(text: str) -> Column:
    return F.sha2(lower_ascii(text_of(text)), 256)


def group_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: the key, ``keep_id`` (the key of the row that stays),
    ``group_size``, ``kept`` and ``text_sha256``. Works on keys and digests, which
    are written first: texts are read once and never shuffled."""
    rows = cut_lineage(docs.select(
        F.col(key).alias("k"), text_digest(text).alias("sha"), F.monotonically_increasing_id().alias("rid")))
    single, double = _split(rows)
    best = double.groupBy("sha").agg(F.max(F.struct("k", "rid")).alias("best"), F.count("*").alias("n"))
    # Written, so that the join gets an exchange on either side and a large group can be split.
    double = double.join(cut_lineage(best), "sha")
    one = single.select(F.col("k").alias(key), F.col("k").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
                        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    more = double.select(F.col("k").alias(key), F.col("best.k").alias("keep_id"), F.col("n").alias("group_size"),
                         (F.col("rid") == F.col("best.rid")).alias("kept"), F.col("sha").alias("text_sha256"))
    return one.unionByName(more)


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns. Rows of a group meet in a
    map-side combined maximum, so a large group is no burden on one task."""
    rows = packed(docs, k=F.col(key), sha=text_digest(text))
    single, double = _split(rows)
    order = F.struct("k", F.xxhash64(F.to_json("row")))
    kept = double.groupBy("sha").agg(F.max_by("row", order).alias("row"))
    return unpacked(single.select("row").unionByName(kept.select("row")))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``sha`` occurs once for certain, and rows where it may repeat."""
    rows = rows.withColumn("h", F.xxhash64("sha"))
    few = _maybe_repeated(cut_lineage(rows.select("h")))
    few = F.broadcast(few) if few.count() <= BROADCAST_HASHES else few
    tested = rows.join(few.withColumn("_maybe", F.lit(True)), "h", "left").drop("h")
    return (tested.filter(F.col("_maybe").isNull()).drop("_maybe"), tested.filter("_maybe").drop("_maybe"))


def _maybe_repeated(hashes: DataFrame) -> DataFrame:
    """The hashes that the filter cannot tell from repeated ones, each once, written."""
    words = max(1, -(-hashes.count() // ROWS_PER_WORD))
    other = F.xxhash64("h")
    bits = F.array(other.bitwiseAND(63).cast("int"), F.shiftrightunsigned(other, 6).bitwiseAND(63).cast("int"))
    placed = hashes.select("h", F.pmod("h", F.lit(words)).alias("w"), bits.alias("bits"))
    # Twice the same bit of one text counts once.
    counted = placed.select("w", F.explode(F.array_distinct("bits")).alias("b")).groupBy("w", "b").count()
    repeated = counted.filter("count > 1").groupBy("w").agg(
        F.bit_or(F.expr("shiftleft(1L, b)")).alias("seen"))
    both = F.expr("shiftrightunsigned(seen, bits[0]) & shiftrightunsigned(seen, bits[1]) & 1 = 1")
    return cut_lineage(placed.join(repeated, "w").filter(both).select("h").distinct())
