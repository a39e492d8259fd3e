"""Writes that check themselves."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """Count rows as they are written.

    Must be the last step before the write: only tasks of the writing stage
    are counted once whatever is retried, a repeated shuffle stage is not.
    """
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def observed_values(seen: Observation) -> dict[str, int]:
    """What was observed. Where Spark found out that there is nothing to
    write, it drops the counting step with the rest, and there are no values."""
    try:
        return dict(seen.get)
    except Py4JJavaError as e:
        if "NoSuchElement" not in e.java_exception.getClass().getName():
            raise
        return {}


def rows_seen(seen: Observation) -> int:
    return observed_values(seen).get("rows", 0)


def parquet_overwrite_verified(df: DataFrame, path: str, *more: DataFrame, **options: str) -> DataFrame:
    """Overwrite ``path``, then compare written and read-back row counts.

    The first count is observed while writing, so the input is computed once.
    ``df`` must not read from ``path``. ``more`` are further parts of the table,
    each computed and written after the one before.
    """
    before = 0
    for part in (df, *more):
        counted, seen = observed(part)
        counted.write.mode("overwrite" if part is df else "append").options(**options).parquet(path)
        before += rows_seen(seen)
    return _read_back(df, path, before)


def _read_back(df: DataFrame, path: str, before: int) -> DataFrame:
    """Count what is on disk; the known schema saves reading footers for it."""
    after = df.sparkSession.read.schema(df.schema).parquet(path).count()
    if before != after:
        raise ValueError(f"wrote {before} rows to {path} but read {after} back")
    return df.sparkSession.createDataFrame([(before, after)], "rows_before bigint, rows_after bigint")


def small_result_sink(df: DataFrame, path: str) -> DataFrame:
    """One output file, for results already reduced to a few rows (an aggregate).

    The rows are exchanged to one task first, so the aggregation itself keeps
    its parallelism.
    """
    counted, seen = observed(df.repartition(1))
    counted.write.mode("overwrite").parquet(path)
    return _read_back(df, path, rows_seen(seen))


def csv_sink(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
