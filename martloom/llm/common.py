"""Helpers shared by the training-text operators."""

from __future__ import annotations

import os
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from martloom.session import stage

#: A word is a maximal run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a plain word: 0-9, A-Z lower-cased, a-z and all of other characters; any other byte parts words.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else 32 for b in range(256))


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


_LOCAL_BITS = 33  # monotonically_increasing_id: partition above, row below


# Runtime settings for rows that hold whole texts.
SETTINGS = {
    # A finished job's shuffle files are of no use to the next job, which reads what
    # the job wrote; without this they stay until the driver collects garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Batches that Python workers hold are bounded by bytes, not only by rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


HOME = str(Path(__file__).resolve().parents[2])


def settle(spark: SparkSession) -> SparkSession:
    """Settings for jobs on texts, and the package on the path of Python workers started from elsewhere."""
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if HOME not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, HOME])
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{column}`")


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns as one struct, so that helper columns cannot clash with them."""
    return F.struct(*[named(c) for c in df.columns]).alias(name)


def unpacked(df: DataFrame, columns: list[str], name: str = "row") -> list[Column]:
    return [F.col(name).getField(c).alias(c) for c in columns]


def fold(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % mod


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def output(rows: DataFrame, kept: list[str], more: str) -> T.StructType:
    """Schema of a Python step: columns kept as they are, whatever their field names, and new ones as DDL."""
    return T.StructType([rows.schema[c] for c in kept] + T.StructType.fromDDL(more).fields)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality of key columns of two aliased frames."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def positions(df: DataFrame, group: list[str], order: list[str], rank: str) -> DataFrame:
    """Add each row's place (from 0) in its group, in the given order.

    No group meets in one task: rows are dealt by ranges of (group, order, input
    position), so equal rows and a hot group are cut too, sorted inside each
    range and written once to the shared folder. A place is the place inside the
    range plus the sizes of the group's earlier ranges. Rows that tie in
    ``order`` are numbered in input order.
    """
    keys = [*group, *order, "__tie"]
    ranged = (
        df.withColumn("__tie", F.monotonically_increasing_id())
        .repartitionByRange(shuffle_partitions(df.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .drop("__tie")
        .withColumn("__pos", F.monotonically_increasing_id())
    )
    pinned = stage(ranged, "positions").withColumn("__part", F.shiftright("__pos", _LOCAL_BITS))
    sizes = stage(
        pinned.groupBy(*group, "__part").agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n")),
        "range-sizes",
    )
    # One row per range that a group touches.
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift")
    )
    placed = pinned.alias("a").join(offsets.alias("b"), same("a", "b", [*group, "__part"]))
    return placed.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a.__pos") + F.col("b.__shift")).alias(rank))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, root), root the least node.

    Alternates the large-star and small-star steps: each keeps the components
    and never adds edges, and a node's neighbours are reduced by ``min`` before
    they are joined back. The joins are null-safe, so that they do not ride on the
    grouping's exchange and the edges of a hub can be split over tasks. Each
    round is written to the shared folder, which also cuts the lineage. Ends when
    every edge hangs on a least node, after about log(longest chain) rounds.
    Nodes without an edge are not in the result.
    """
    links = stage(
        edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u <> v").distinct(), "links"
    )
    while True:
        both = links.select("v", "u").union(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        # Large star: every larger neighbour of v hangs on the least node around v.
        large = (
            both.where("u > v").alias("e").join(least.alias("l"), same("e", "l", ["v"]))
            .select(F.col("e.u").alias("v"), F.col("l.m").alias("u"))
        )
        large = stage(large.distinct(), "large-star")
        # Small star: the smaller neighbours of v, and v, hang on the least of them.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.alias("e").join(low.alias("l"), same("e", "l", ["v"]))
            .select(F.col("e.u").alias("v"), F.col("l.m").alias("u")).where("u <> v")
            .union(low.select("v", F.col("m").alias("u")))
        )
        links = stage(small.distinct(), "small-star")
        # Finished when no node has two parents and no parent has a parent.
        parents = links.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        chained = links.alias("e").join(parents.alias("p"), F.col("e.u") == F.col("p.v"), "left_semi")
        if parents.where("n > 1").isEmpty() and chained.isEmpty():
            roots = links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
            return links.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots)
