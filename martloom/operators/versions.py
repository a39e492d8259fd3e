"""Corrections and the newest version of each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martloom.functions.columns import count_if

# ---- fixed values: version marks -----------------------------------------
ORIGINAL = "ORIGINAL"
CORRECTED = "CORRECTED"

TIME, SOURCE = "record_update_time", "record_source"


def versioned(df: DataFrame, source: str, update_time) -> DataFrame:
    return df.withColumns({TIME: update_time, SOURCE: F.lit(source)})


def _lead(source: Column) -> Column:
    """The first seven bytes of a text as a number that sorts like it; a missing text is below all."""
    digits = F.rpad(F.hex(F.substring(source.cast("binary"), 1, 7)), 14, "0")
    return F.coalesce(F.conv(digits, 16, 10).cast("bigint"), F.lit(-1).cast("bigint"))


def newest(rows: DataFrame, key: str) -> DataFrame:
    """(key, t, lead, ties): greatest time per key, greatest start of a source at that time, rows at that time.

    Fixed-width values only, so both groupings are hash aggregates that combine
    before their shuffle: a key with very many versions arrives as few rows.
    """
    per_time = rows.groupBy(key, F.col(TIME).alias("t")).agg(F.max(_lead(F.col(SOURCE))).alias("lead"), F.count(F.lit(1)).alias("n"))
    return per_time.groupBy(F.col(key).alias("__key")).agg(
        F.max("t").alias("__t"), F.max_by("lead", "t").alias("__lead"), F.max_by("n", "t").alias("__ties")
    )


def latest_version(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Newest record per key: later update time, then greater source, then greater rest of row; nulls are least.

    Rows meet the newest time of their key in a join that Spark can split when
    a key is hot. Only where several rows of a key share that time are whole rows
    compared, in a window whose row limit is applied before its shuffle.
    """
    rows = base.unionByName(delta)
    columns = base.columns
    # All times of a key may be missing; then every row of it is a candidate.
    at = F.col(TIME).eqNullSafe(F.col("__t")) & (F.col("__t").isNull() | (_lead(F.col(SOURCE)) == F.col("__lead")))
    found = rows.join(newest(rows, key), F.col(key).eqNullSafe(F.col("__key")) & at)
    alone = F.coalesce(F.col("__ties"), F.lit(2)) == 1
    rest = [c for c in columns if c not in (key, TIME, SOURCE)]
    order = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in (SOURCE, *rest)])
    tied = found.where(~alone).withColumn("__place", F.row_number().over(order)).where("__place = 1")
    return found.where(alone).select(*columns).unionByName(tied.select(*columns))


def merge_checks(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Row counts before and after, repeated keys in the union, corrected rows kept."""
    both = base.unionByName(delta)
    per_time = both.groupBy(key, F.col(TIME).alias("t")).agg(
        count_if(F.col(SOURCE) == ORIGINAL).alias("original"),
        count_if(F.col(SOURCE) == CORRECTED).alias("corrected"),
        F.count(F.lit(1)).alias("n"),
        F.max(_lead(F.col(SOURCE))).alias("lead"),
    )
    per_key = per_time.groupBy(key).agg(
        F.sum("original").alias("base_rows"),
        F.sum("corrected").alias("delta_rows"),
        F.sum("n").alias("n"),
        F.coalesce(F.max_by("lead", "t"), F.max("lead")).alias("kept"),
    )
    return per_key.agg(
        F.coalesce(F.sum("base_rows"), F.lit(0)).alias("base_rows"),
        F.coalesce(F.sum("delta_rows"), F.lit(0)).alias("delta_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("combined_rows"),
        count_if(F.col("n") > 1).alias("repeated_keys"),
        F.count(F.lit(1)).alias("merged_rows"),
        count_if(F.col("kept") == _lead(F.lit(CORRECTED))).alias("corrected_kept"),
    )


def require_merged(checks: DataFrame, merged: DataFrame, key: str) -> None:
    """Stop unless a merged table holds each key of base and delta once and as many corrected rows as won."""
    want = checks.first()
    per_key = merged.groupBy(key).agg(F.count(F.lit(1)).alias("n"), count_if(F.col(SOURCE) == CORRECTED).alias("c"))
    got = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("merged_rows"),
        F.count(F.lit(1)).alias("keys"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("corrected_kept"),
    ).first()
    failed = {
        name: (expected, actual)
        for name, expected, actual in (
            ("merged_rows", want.merged_rows, got.merged_rows),
            ("keys", want.merged_rows, got["keys"]),
            ("corrected_kept", want.corrected_kept, got.corrected_kept),
        )
        if expected != actual
    }
    if failed:
        raise ValueError(f"merge failed (expected, actual): {failed}")
