"""Shards by jump consistent hashing (Lamping and Veach).

The shard follows from the key and the number of shards alone: no ring table, no
state, and with one more shard a key either stays or moves to the new one.

Defined cases: a null key is one more key value; equal keys share a shard; an
empty table gives an empty result; an input column named like an added one gives
way to it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from anomalens.llm.common import numbered, packed, unpacked

CHUNK_ROWS = 4096
_STEP = np.uint64(2862933555777941757)  # fixed value of the published generator


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every 64-bit key."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    landed = np.zeros(len(state), np.int64)
    while len(live):
        shard[live] = landed[live]
        state[live] = state[live] * _STEP + np.uint64(1)
        high = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        landed[live] = ((shard[live] + 1) * (2147483648.0 / high)).astype(np.int64)
        live = live[landed[live] < shards]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key column of any hashable type."""

    @F.pandas_udf("int")
    def place(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy(), shards))
    return place(F.xxhash64(key))


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = 16, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``shard``, ``grown_shard`` (the shard if there were one more) and ``slot``
    (gapless from 0 within the shard). Slots follow a hash of the whole row, in
    chunks of about ``chunk_rows``; the row that is hashed decides, so reruns agree
    up to rows equal in every column."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    chunks = max(1, -(-df.count() // (shards * chunk_rows)))
    rows = packed(df, shard=shard_of(F.col(key), shards), grown=shard_of(F.col(key), shards + 1),
                  h=F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    rows = numbered(rows, ["shard"], F.pmod(F.xxhash64("h"), F.lit(chunks)), [F.col("h")], "slot")
    return unpacked(rows, shard=F.col("shard"), grown_shard=F.col("grown"), slot=F.col("slot"))
