"""Sharding by jump consistent hashing: a stable key's shard follows from the key and the number of shards alone.

Cases: a null doc_id is one key like any other; rows of one doc_id share a shard and have a slot each. A null text has
no bytes and the CRC of the empty text. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterframe.llm.blocks import mix
from meterframe.llm.shared import checkpointed

_U = np.uint64
NULL_KEY = 0x5851F42D4C957F2D


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Lamping and Veach's jump consistent hash of unsigned 64-bit keys."""
    state = keys.astype(_U)
    at, ahead = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        at[moving] = ahead[moving]
        state[moving] = state[moving] * _U(2862933555777941757) + _U(1)
        ahead[moving] = ((at[moving] + 1) * (float(1 << 31) / ((state[moving] >> _U(33)).astype(np.float64) + 1.0))).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return at


def shard_of(key: F.Column, shards: int) -> F.Column:
    """The shard of a long key: its splitmix64 value goes through the jump hash."""

    @F.pandas_udf("int")
    def run(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        mixed = np.full(len(ids), NULL_KEY, _U)
        mixed[known] = mix(ids[known].to_numpy(np.int64).view(_U))
        return pd.Series(jump(mixed, shards).astype(np.int32))

    return run(key)


def assign(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """Each row's shard, its gapless slot there, and its shard if one more were appended.

    Slots are numbered in two levels, within a (shard, input partition) and over the partitions' counts, so that no
    task holds a whole shard.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = checkpointed(sized.select("*", shard_of(F.col("doc_id"), shards).alias("shard"), shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"), F.monotonically_increasing_id().alias("row")))
    dealt = placed.withColumn("part", F.shiftright("row", 33))
    counts = dealt.groupBy("shard", "part").count()
    start = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "part", start.alias("start"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1)
    return ranked.join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"), "grown_shard")
