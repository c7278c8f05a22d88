"""Sharding by jump consistent hashing.

A key walks through the shard counts 1, 2, 3, ... and jumps to the newest shard with
probability 1 / count; the last jump below the wanted count is its shard. There is no
ring table: the 64-bit key and the count decide, shards come out even for any number
of keys, and with one more shard a key either stays or moves into the new one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearvote.llm import common

# Fixed values of the published jump hash: multiplier of its generator, range of a draw.
_MULTIPLIER = np.uint64(2862933555777941757)
_RANGE = float(1 << 31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key; all keys take their jumps together."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    nxt = np.zeros(len(state), np.float64)
    moving = np.arange(len(state))
    while moving.size:
        shard[moving] = nxt[moving].astype(np.int64)
        state[moving] = state[moving] * _MULTIPLIER + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        nxt[moving] = np.floor((shard[moving] + 1) * (_RANGE / draw))
        moving = moving[nxt[moving] < shards]
    return shard.astype(np.int32)


def jump_column(shards: int):
    """Column function: shard of a bigint key; a null key counts as 0."""

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.fillna(0).to_numpy(np.int64), shards))

    return shard_of


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    ``size`` is the text's UTF-8 bytes plus 1 and ``text_crc32`` its crc32 (null: no
    bytes). ``slot`` numbers a shard's rows 0, 1, ... ; ``grown_shard`` is the shard
    after one is appended. Only ids go through Python. Rows that repeat an id share its
    shard and get slots of their own, in any order; a null id counts as key 0.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce("id", F.lit(0))
    rows = common.documents(docs, id_col, text_col).select(
        F.col("id").alias("doc_id"),
        (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_column(shards)(key).alias("shard"),
        jump_column(shards + 1)(key).alias("grown_shard"),
    )
    numbered = common.gapless(rows, "shard", "doc_id", "slot", shards, ("size", "text_crc32"))
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
