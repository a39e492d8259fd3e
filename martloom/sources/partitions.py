"""Month-partitioned tables and incremental loads."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.functions import fixed
from martloom.operators import versions
from martloom.session import file_sized, stage
from martloom.sources.publish import Folder, incoming, publish, repair
from martloom.sources.sinks import observed, rows_seen

PARTITION = "order_month"


def with_month(df: DataFrame) -> DataFrame:
    day = F.to_date("order_time")
    return df.withColumns({"order_date": day, PARTITION: F.date_format(day, fixed.MONTH_FORMAT)})


def month_rows(df: DataFrame) -> DataFrame:
    """Rows per month; the NULL month holds rows that cannot be placed."""
    return with_month(df).groupBy(PARTITION).agg(F.count(F.lit(1)).alias("row_count"))


#: Rows to the same rows with more columns.
Rows = Callable[[DataFrame], DataFrame]


def _write(df: DataFrame, path: str, mode: str | None, derive: Rows | None = None) -> int:
    """Write by month. Returns the row count, observed while writing.

    ``rebalance`` gathers each month's rows into few files, but lets Spark
    split a month that is much larger than the others. ``derive`` makes the
    columns of the table from those that were dealt out.
    """
    dealt = df.hint("rebalance", F.col(PARTITION))
    counted, seen = observed(derive(dealt) if derive else dealt)
    writer = counted.write.mode("overwrite").partitionBy(PARTITION)
    if mode:
        writer = writer.option("partitionOverwriteMode", mode)
    with file_sized(df.sparkSession):
        writer.parquet(path)
    return rows_seen(seen)


def month_partition_write(df: DataFrame, path: str, derive: Rows | None = None) -> DataFrame:
    """Write every placeable row by month; returns rows per month as written.

    Rows without a month cannot be placed. They are counted in a row whose month
    is NULL; there is no such row when there are none.
    """
    spark = df.sparkSession
    dropped = df.filter(F.to_date("order_time").isNull()).count()
    written = _write(with_month(df).filter(F.col(PARTITION).isNotNull()), path, "static", derive)
    left = spark.createDataFrame([(None, dropped)] if dropped else [], f"{PARTITION} string, row_count bigint")
    # Nothing written means no month folder, which could not be read back.
    return partition_rows(spark, path).unionByName(left) if written else left


def read_months(spark: SparkSession, path: str) -> DataFrame:
    """Months stay text: partition discovery must not guess their type."""
    found = spark.read.parquet(path)
    return found.withColumn(PARTITION, F.col(PARTITION).cast("string"))


def has_months(spark: SparkSession, path: str) -> bool:
    return any(name.startswith(f"{PARTITION}=") for name in Folder(spark, path).names(""))


def partition_rows(spark: SparkSession, path: str) -> DataFrame:
    return read_months(spark, path).groupBy(PARTITION).agg(F.count(F.lit(1)).alias("row_count"))


def month_pruned_scan(spark: SparkSession, path: str, month: str) -> DataFrame:
    """One month; the filter is on the partition column itself, so only that
    directory is listed and read."""
    return spark.read.parquet(path).filter(F.col(PARTITION) == check_month(month))


def check_month(month: str) -> str:
    """``YYYY-MM`` with a real month, or ValueError."""
    if not re.fullmatch(fixed.MONTH_PATTERN, month):
        raise ValueError(f"month must look like 2025-01, got {month!r}")
    year, number = map(int, month.split("-"))
    try:
        date(year, number, 1)
    except ValueError as e:
        raise ValueError(f"not a calendar month: {month}") from e
    return month


def in_month(df: DataFrame, month: str) -> DataFrame:
    """Rows of one month as a time range, which the Parquet scan can push down."""
    year, number = map(int, check_month(month).split("-"))
    first = f"{year:04d}-{number:02d}-01 00:00:00"
    following = (year + number // 12, number % 12 + 1)
    end = f"{following[0]:04d}-{following[1]:02d}-01 00:00:00"
    time = F.col("order_time")
    kind = dict(df.dtypes)["order_time"]
    return df.filter((time >= F.lit(first).cast(kind)) & (time < F.lit(end).cast(kind)))


def dynamic_partition_overwrite(df: DataFrame, month: str, path: str, derive: Rows | None = None) -> int:
    """Replace one month of the table at ``path``; other months are not touched.

    ``df`` must not read from ``path``. Returns the rows written.
    """
    return _write(with_month(in_month(df, month)), path, "dynamic", derive)


def _split(spark: SparkSession, path: str, month: str) -> tuple[int, int]:
    """Rows in ``month`` and in all others; 0, 0 while there is no table."""
    if not has_months(spark, path):
        return 0, 0
    target = F.col(PARTITION) == month
    row = (
        read_months(spark, path)
        .agg(F.count(F.when(target, 1)).alias("target"), F.count(F.when(~target, 1)).alias("other"))
        .first()
    )
    return row.target, row.other


def incremental_month_job(df: DataFrame, month: str, path: str, derive: Rows | None = None) -> DataFrame:
    """Load one month and check it: three rows, (check, expected, actual, passed).

    The month is written aside and checked there; only a month that passes
    replaces the old one. Zero rows is an error. A job that an earlier one left
    half published is finished first.
    """
    spark = df.sparkSession
    repair(spark, path)
    before_target, before_other = _split(spark, path, check_month(month))
    staged = incoming(path)
    loaded = _write(with_month(in_month(df, month)), staged, "static", derive)
    if loaded == 0:
        repair(spark, path)  # drops what is not marked
        raise ValueError(f"no rows for month {month}")
    target, stray = _split(spark, staged, month)
    other = _split(spark, path, month)[1] + stray
    checks = [
        ("target_month", loaded, target),
        ("other_months", before_other, other),
        ("total", before_other + loaded, target + other),
    ]
    failed = [name for name, want, got in checks if want != got]
    if failed:
        repair(spark, path)
        raise ValueError(f"incremental load of {month} failed: {failed}")
    publish(spark, path, staged, [f"{PARTITION}={month}"])
    rows = [(name, want, got, want == got) for name, want, got in checks]
    return spark.createDataFrame(rows, "check_name string, expected bigint, actual bigint, passed boolean")


def upsert_months(delta: DataFrame, path: str, key: str) -> DataFrame:
    """Merge corrections into a month table; returns (order_month, rows_before, rows_after) of the months rewritten.

    Only months are read and rewritten in which a key of ``delta`` stands or to
    which it comes; a record may move from one month to another. The newest
    version per key wins (``versions.latest_version``). The merged months are
    written aside, checked against counts taken from base and delta, and then
    published; a failed check leaves the table as it was. ``delta`` must have a
    month in every row and the table's columns.
    """
    spark = delta.sparkSession
    repair(spark, path)
    delta = stage(with_month(delta), "delta")
    if not delta.filter(F.col(PARTITION).isNull()).isEmpty():
        raise ValueError("corrections without a month cannot be placed")
    table = read_months(spark, path) if has_months(spark, path) else delta.limit(0)
    keys = delta.select(F.col(key).alias("__delta")).distinct()
    standing = table.join(keys, F.col(key).eqNullSafe(F.col("__delta")), "left_semi").select(PARTITION)
    # One row per month of the calendar.
    months = sorted(r[0] for r in standing.union(delta.select(PARTITION)).distinct().collect())
    base = table.where(F.col(PARTITION).isin(months)).select(*delta.columns)
    staged = incoming(path)
    _write(versions.latest_version(base, delta, key), staged, "static")
    merged = read_months(spark, staged) if months else base
    try:
        versions.require_merged(versions.merge_checks(base, delta, key), merged, key)
        before = base.groupBy(PARTITION).agg(F.count(F.lit(1)).alias("rows_before"))
        after = merged.groupBy(PARTITION).agg(F.count(F.lit(1)).alias("rows_after"))
        rows = before.join(after, PARTITION, "full").select(
            PARTITION, F.coalesce("rows_before", F.lit(0)).alias("rows_before"), F.coalesce("rows_after", F.lit(0)).alias("rows_after")
        ).collect()
    except ValueError:
        repair(spark, path)
        raise
    if months:
        publish(spark, path, staged, [f"{PARTITION}={m}" for m in months])
    return spark.createDataFrame(rows, f"{PARTITION} string, rows_before bigint, rows_after bigint")
