"""Sharding by jump consistent hashing.

A stable 64-bit hash of the key walks a short sequence of jumps that ends in
its shard; no ring table is kept, and when one shard is added only the share of
rows that belongs into the new shard moves, and only into it.

Defined results: equal keys always meet in one shard; a null key is a key of
its own; a null text has no bytes, a text of any length is one row. A key has the same
shard as a number of any width and as its text. Repeated rows keep a slot each. An
empty table gives no rows. Extra columns are carried.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.llm.common import named, packed, positions, table, unpacked
from martloom.session import stage

SHARDS = 40
OVERHEAD = 16  # bytes that a record takes besides its text


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key (Lamping and Veach, 2014)."""
    key = keys.astype(np.uint64)
    at = np.zeros(len(key), np.int64)
    target = np.zeros(len(key), np.int64)
    moving = np.arange(len(key))
    while len(moving):
        at[moving] = target[moving]
        key[moving] = key[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (1 << 31) / ((key[moving] >> np.uint64(33)).astype(np.float64) + 1.0)
        target[moving] = ((at[moving] + 1) * step).astype(np.int64)
        moving = moving[target[moving] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key column; the hash of the key as text is what jumps, whatever its type."""

    @F.pandas_udf("int")
    def jumped(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return jumped(F.xxhash64(key.cast("string")))


def assign(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """Documents (columns in ``row``) with ``shard``, and ``grown_shard`` after adding one shard."""
    return docs.select(
        packed(docs), shard_of(named(key), shards).alias("shard"), shard_of(named(key), shards + 1).alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS) -> None:
    """One folder per shard; ``rebalance`` lets a large shard have several files."""
    placed = assign(docs, key, shards)
    out = placed.select(*unpacked(placed, docs.columns), F.col("shard").alias("__shard"))
    out.hint("rebalance", "__shard").write.partitionBy("__shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = assign(docs)
    narrow = stage(placed.select(*unpacked(placed, docs.columns), "shard", "grown_shard"), "shards")
    numbered = positions(narrow, ["shard"], ["doc_id", "text_crc32"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
