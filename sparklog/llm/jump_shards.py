"""Sharding by jump consistent hashing: a document's id and the number of shards decide its shard; with one more shard
only the rows that move into it change place."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklog.llm.common import stored, text_of

SHARDS = 40
ROW_BYTES = 16
#: Chunks per shard in which the slots are counted.
CHUNKS = 1024
#: The multiplier of the generator in Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm".
STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; all keys jump together until each has passed the last shard."""
    state = keys.astype(np.uint64)
    shard, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        shard[moving] = ahead[moving]
        state[moving] = state[moving] * STEP + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1
        ahead[moving] = ((shard[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return shard


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a long key."""

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy().view(np.uint64), shards).astype(np.int32))

    return of(key)


def place(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Only narrow rows are shuffled. Slots number the rows of a shard from 0: rows are numbered inside hash chunks of the
    shard, and a chunk starts after the rows of the chunks before it, so no task sees a whole shard. Null texts have no
    bytes; null ids share one shard. Rows with equal id and text share a shard and take neighbouring slots. Extra
    columns are not read.
    """
    text = text_of(docs)
    key = F.xxhash64("doc_id")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("key"),
    ).withColumn("shard", jump_shard(F.col("key"), shards)).withColumn(
        "grown_shard", jump_shard(F.col("key"), shards + 1)).withColumn(
        "chunk", F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(CHUNKS)).cast("int")).drop("key")
    kept = stored(rows, "shard-rows")
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy("shard", "chunk").agg(F.count("*").alias("n")).select(
        "shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")
    return kept.withColumn("nth", F.row_number().over(inside)).join(starts, ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes the documents to one folder per shard, ``shard=N``, in files of bounded size."""
    (
        docs.withColumn("shard", jump_shard(F.xxhash64("doc_id"), shards))
        .hint("rebalance", F.col("shard")).write.option("maxRecordsPerFile", 1_000_000).partitionBy("shard").parquet(path)
    )
