"""Registration of queries, and one output shape for Spark and SQL.

A shape such as ``"day:y orders:i amount:d"`` names the columns and their
kinds: s text, i bigint, d double, b boolean, t time as text, y day as text.
Both sides are cast through it, so names and types agree by construction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.model_sql import MODEL
from martloom.session import scratch_path, stage, tune
from martloom.sources.retail import FaultyTables, RetailTables

SPARK_KIND = {
    "s": lambda c: c.cast("string"),
    "i": lambda c: c.cast("bigint"),
    "d": lambda c: c.cast("double"),
    "b": lambda c: c.cast("boolean"),
    "t": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
    "y": lambda c: F.date_format(c, "yyyy-MM-dd"),
}
SQL_KIND = {
    "s": "CAST({c} AS VARCHAR)",
    "i": "CAST({c} AS BIGINT)",
    "d": "CAST({c} AS DOUBLE)",
    "b": "CAST({c} AS BOOLEAN)",
    "t": "strftime({c}, '%Y-%m-%d %H:%M:%S')",
    "y": "strftime({c}, '%Y-%m-%d')",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _pairs(shape: str) -> list[tuple[str, str]]:
    return [tuple(p.split(":")) for p in shape.split()]


def present(df: DataFrame, shape: str) -> DataFrame:
    return df.select(*[SPARK_KIND[k](F.col(n)).alias(n) for n, k in _pairs(shape)])


def shaped_sql(body: str, shape: str) -> str:
    columns = ", ".join(f"{SQL_KIND[k].format(c=n)} AS {n}" for n, k in _pairs(shape))
    return f"{MODEL}\nSELECT {columns} FROM (\n{body}\n) AS shaped"


class Tables:
    """The test tables behind one query run."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.clean = RetailTables(spark, folder)
        self.faulty = FaultyTables(spark, folder)
        self.statuses = self.clean.statuses

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        return stage(df, name)


def query(key: str, shape: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return present(fn(Tables(tune(spark), folder)), shape)

        run.__name__ = key
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = shaped_sql(sql, shape)
        return fn

    return register
