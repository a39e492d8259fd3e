"""The four warehouse tables from strict, all-text CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.functions import fixed
from martloom.functions.columns import TRY_CASTS
from martloom.operators.clean import clean_table, ingested
from martloom.sources import schemas
from martloom.sources.tables import csv_strict_scan


class CsvTables:
    """``folder`` holds order.csv, order_detail.csv, customer.csv, product.csv
    (files or directories). Values that do not convert stop the ingest."""

    statuses = fixed.VALID_SALES_STATUSES

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return csv_strict_scan(self.spark, f"{self.folder}/{name}.csv", schemas.TABLES[name])

    def _typed(self, name: str) -> DataFrame:
        return ingested(self.raw(name), schemas.TABLES[name], name.replace("_", "-"))

    def order(self, with_area: bool = True) -> DataFrame:
        return self._typed("order")

    def detail(self) -> DataFrame:
        return self._typed("order_detail")

    def customer(self) -> DataFrame:
        return self._typed("customer")

    def product(self) -> DataFrame:
        return self._typed("product")

    def cleaned(self, name: str) -> DataFrame:
        """The lenient alternative: duplicates dropped, unreadable values NULL or 0."""
        return clean_table(self.raw(name))


class CleanedCsvTables(CsvTables):
    """The same files through the clean step of the order-driven warehouse:
    whole duplicates dropped, texts trimmed, unreadable money 0, other unreadable values NULL."""

    def _typed(self, name: str) -> DataFrame:
        declared = schemas.TABLES[name]
        clean = self.cleaned(name)
        # What the clean step leaves as text, such as whole numbers, gets its declared type.
        return clean.select(
            *[TRY_CASTS[kind](F.col(c)).alias(c) if dict(clean.dtypes)[c] == "string" else F.col(c) for c, kind in declared.items()]
        )
