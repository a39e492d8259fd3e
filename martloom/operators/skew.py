"""Hot keys: finding them, salting them, looking at partition balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.functions import fixed
from martloom.functions.columns import half_up

HOT_KEY_LIMIT = 64
COUNTERS_PER_KEY = 64  # the sketch's counters for each key it may name


def hot_keys(df: DataFrame, key: str, limit: int = HOT_KEY_LIMIT) -> DataFrame:
    """Keys holding at least one row in ``limit``: at most ``limit`` of them, NULL included.

    Found in one pass by a frequent-items sketch: each task keeps a bounded set of
    counters, and sketches are merged. Its counts are off by a small share of
    the rows at most, so a key just below the limit may be named too; a key is
    only spread by that, never counted wrong.
    """
    counters = min(limit * COUNTERS_PER_KEY, 1_000_000)
    # Built-in of the SQL dialect; it has no Python wrapper.
    top = F.expr(f"approx_top_k(`{key}`, {int(limit)}, {int(counters)})")
    seen = df.agg(top.alias("top"), F.count(F.lit(1)).alias("total"))
    named = seen.select(F.inline("top"), "total")
    return named.filter(F.col("count") * limit >= F.col("total")).select(F.col("item").alias(key))


def salted_aggregate(
    df: DataFrame, key: str, value: str, row_id: str, salts: int = fixed.SALT_BUCKETS, limit: int = HOT_KEY_LIMIT
) -> DataFrame:
    """Count and sum per key in two steps; rows of hot keys are spread by salt.

    The hot-key list has at most ``limit`` rows, so broadcasting it is
    safe. Both steps are sums, so the result equals the plain aggregate.
    """
    hot = hot_keys(df, key, limit).select(F.col(key).alias("__hot"), F.lit(True).alias("__is_hot"))
    salt = F.when(F.col("__is_hot"), F.pmod(F.hash(row_id), F.lit(salts))).otherwise(F.lit(0))
    return (
        df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__hot")), "left")
        .withColumn("salt", salt)
        .groupBy(key, "salt")
        .agg(F.count(F.lit(1)).alias("part_rows"), F.sum(value).alias("part_total"))
        .groupBy(key)
        .agg(F.sum("part_rows").alias("row_count"), F.sum("part_total").alias("total_amount"))
    )


def key_skew_audit(df: DataFrame, keys: str | list[str]) -> DataFrame:
    """One row per column: NULLs, distinct keys, rows, largest and mean group, ratio, verdict.

    The keys of all columns are counted in one grouping of (column, key).
    """
    names = [keys] if isinstance(keys, str) else list(keys)
    entries = [F.struct(F.lit(k).alias("column_name"), F.col(k).cast("string").alias("key")) for k in names]
    counts = df.select(F.inline(F.array(*entries))).groupBy("column_name", "key").agg(F.count(F.lit(1)).alias("n"))
    # A row of nothing per column, so that a column of an empty table is reported too.
    nothing = df.sparkSession.createDataFrame([(k, None, 0) for k in names], "column_name string, key string, n bigint")
    has_key = F.col("key").isNotNull()
    spread = F.col("max_rows") * F.col("key_count")
    ratio = half_up(spread, F.col("total_rows"), 2)
    return (
        counts.unionByName(nothing).groupBy("column_name").agg(
            F.coalesce(F.sum(F.when(~has_key, F.col("n"))), F.lit(0)).alias("null_count"),
            F.count("key").alias("key_count"),
            F.coalesce(F.sum(F.when(has_key, F.col("n"))), F.lit(0)).alias("total_rows"),
            F.coalesce(F.max(F.when(has_key, F.col("n"))), F.lit(0)).alias("max_rows"),
        )
        .withColumns(
            {
                "avg_rows": F.coalesce(half_up(F.col("total_rows"), F.col("key_count"), 2), F.lit(0)),
                "skew_ratio": F.coalesce(ratio, F.lit(0)),
            }
        )
        .select(
            "*",
            F.when(F.col("total_rows") == 0, "even")
            .when(spread >= F.col("total_rows") * fixed.SKEW_HOT, "hot")
            .when(spread >= F.col("total_rows") * fixed.SKEW_WATCH, "watch")
            .otherwise("even")
            .alias("verdict"),
        )
    )


def top_keys(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy(F.desc("row_count"), F.asc(key))
        .limit(n)
    )


def partition_rows(df: DataFrame) -> DataFrame:
    """Rows per physical partition; empty partitions do not appear."""
    return (
        df.select(F.spark_partition_id().alias("partition_id"))
        .groupBy("partition_id")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def partition_balance(df: DataFrame, key: str, parts: int = 8, fewer: int = 2) -> DataFrame:
    """Rows, partitions used, largest partition: as read, repartitioned, coalesced."""

    def summary(layout: str, frame: DataFrame) -> DataFrame:
        return (
            partition_rows(frame)
            .agg(
                F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
                F.count(F.lit(1)).alias("partitions_used"),
                F.max("row_count").alias("max_rows"),
            )
            .select(F.lit(layout).alias("layout"), "*")
        )

    narrow = df.select(key)
    spread = narrow.repartition(parts, key)
    return (
        summary("as read", narrow)
        .unionByName(summary("repartitioned", spread))
        .unionByName(summary("coalesced", spread.coalesce(fewer)))
    )
