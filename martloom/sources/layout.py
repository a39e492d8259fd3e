"""Files behind a table: counts, sizes, compaction."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martloom.functions import fixed
from martloom.functions.columns import beside, half_up
from martloom.sources.tables import path_exists


def table_files(spark: SparkSession, path: str) -> DataFrame:
    """File paths and lengths from the listing alone; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select("path", "length")
    )


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_count) per file. No column is asked for, so tasks read the files' footers only."""
    return spark.read.parquet(path).select(F.col("_metadata.file_path").alias("path")).groupBy("path").agg(
        F.count(F.lit(1)).alias("row_count")
    )


def _partition(path: Column, root: str) -> Column:
    """The ``column=value`` folders of a file below its table; empty where there are none."""
    below = F.regexp_replace(path, f"^.*{re.escape(root.rstrip('/').rsplit('/', 1)[-1])}/", "")
    return F.array_join(F.filter(F.split(below, "/"), lambda part: part.contains("=")), "/")


def file_layout_audit(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Per table: whether it is there, files, partitions, MB, mean MB, rows, rows of the largest file,
    small-file warning, broadcast candidate. Listings and footers only; a missing table is a row too."""
    mb = F.lit(1024 * 1024)
    parts = []
    for name, path in paths.items():
        there = path_exists(spark, path) and not table_files(spark, path).isEmpty()
        if there:
            files = table_files(spark, path).agg(
                F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.countDistinct(_partition(F.col("path"), path)).alias("partitions")
            )
            rows = footers(spark, path).agg(F.sum("row_count").alias("row_count"), F.max("row_count").alias("largest_file_rows"))
            one = beside(files, rows)
        else:
            one = spark.createDataFrame([(0, 0, 0, 0, 0)], "files bigint, bytes bigint, partitions bigint, row_count bigint, largest_file_rows bigint")
        parts.append(one.select(F.lit(name).alias("table_name"), F.lit(there).alias("present"), *one.columns))
    many = F.col("files") >= fixed.SMALL_FILE_COUNT
    tiny = F.col("bytes") < F.col("files") * mb * fixed.SMALL_FILE_MB
    return reduce(DataFrame.unionByName, parts).select(
        "table_name",
        "present",
        "files",
        "partitions",
        "bytes",
        half_up(F.col("bytes"), mb, 2).alias("mb"),
        F.coalesce(half_up(F.col("bytes"), mb * F.col("files"), 2), F.lit(0)).alias("avg_mb"),
        "row_count",
        "largest_file_rows",
        (many & tiny).alias("small_files"),
        (F.col("present") & (F.col("bytes") <= mb * fixed.BROADCAST_MB)).alias("broadcastable"),
    )


TARGET_BYTES = 128 << 20


def _dealt_in_order(spark: SparkSession, path: str, files: int) -> DataFrame:
    """Rows of ``path`` in ``files`` partitions of even counts, each a stretch of the table in the order of its files.

    Rows that stood together stay together, so the files stay as small as the source's. The place follows from
    file and row number alone: a retried task deals alike, and no sort is needed for that.
    """
    df, file = spark.read.parquet(path), F.col("_metadata.file_path").alias("__path")
    # One row per source file, from footers and the listing that the rows are read by.
    counts = df.select(file).groupBy("__path").agg(F.count(F.lit(1)).alias("__rows"))
    before, whole = Window.orderBy("__path").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    offsets = counts.select(
        "__path",
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"),
        F.sum("__rows").over(whole).alias("__total"),
    )
    placed = df.select("*", file, F.col("_metadata.row_index").alias("__row"))
    share = F.call_function("div", (F.col("__offset") + F.col("__row")) * files, F.col("__total")).cast("int")
    dealt = placed.join(F.broadcast(offsets), "__path").select(*placed.columns, share.alias("__file"))
    return dealt.drop("__path", "__row").repartitionById(files, "__file").drop("__file")


def small_file_compaction(
    spark: SparkSession, source: str, target: str, mode: str = "repartition", target_bytes: int = TARGET_BYTES
) -> DataFrame:
    """Rewrite ``source`` at ``target`` with files of about ``target_bytes``; rows must not change.

    The number of files, and so of writing tasks, follows the listed bytes; a file is written by one task, which
    reads all that the file holds. ``repartition`` shuffles to even files; ``coalesce`` merges without one.
    """
    if source == target:
        raise ValueError("a table cannot be rewritten onto itself while it is read")
    listed = table_files(spark, source).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    files = max(1, -(-listed.bytes // target_bytes))
    if mode == "repartition":
        out = _dealt_in_order(spark, source, files)
    elif mode == "coalesce":
        out = spark.read.parquet(source).coalesce(files)
    else:
        raise ValueError(f"unknown compaction mode: {mode}")
    out.write.mode("overwrite").option("compression", "zstd").parquet(target)

    def rows(path: str, name: str) -> DataFrame:
        return spark.read.parquet(path).agg(F.count(F.lit(1)).alias(name))

    count = table_files(spark, target).agg(F.count(F.lit(1)).alias("files"))
    return beside(rows(source, "rows_before"), rows(target, "rows_after"), count).select(
        F.lit(mode).alias("mode"), "files", "rows_before", "rows_after"
    )
