"""Typing, lenient cleaning, duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from martloom.functions.columns import MONEY, TRY_CASTS, count_if, to_rows
from martloom.session import stage
from martloom.sources.sinks import observed_values

# ---- fixed values: columns the lenient cleaner looks for ------------------
MONEY_COLUMNS = (
    "order_amount",
    "coupon_amount",
    "freight_amount",
    "payable_amount",
    "unit_price",
    "actual_amount",
)
FILL_COLUMNS = ("order_amount", "coupon_amount", "freight_amount", "payable_amount", "actual_amount")
TIME_COLUMNS = ("order_time", "updated_at", "created_at", "register_time")
CODE_COLUMNS = ("receiver_province_code", "province_code", "shop_id", "customer_id", "product_id")


def uncastable_counts(raw: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Per typed column, values that are not blank and do not convert.

    One aggregate over the table; ``bad`` above zero fails an ingest.
    """
    found = uncastable(declared)
    counts = raw.agg(*[n.alias(c) for c, n in found.items()])
    return to_rows(counts, {c: F.col(c) for c in found}, "column_name", "bad")


def uncastable(declared: dict[str, str]) -> dict[str, Column]:
    """Per typed column an aggregate: values that are not blank and do not convert."""
    return {c: count_if((F.trim(c) != "") & TRY_CASTS[kind](F.col(c)).isNull()) for c, kind in declared.items() if kind != "string"}


def ingested(raw: DataFrame, declared: dict[str, str], name: str) -> DataFrame:
    """The typed table, staged; the text is parsed once.

    Values that do not convert are counted while the typed rows are written.
    Any such value stops the ingest, with the number per column.
    """
    seen = Observation()
    counted = raw.observe(seen, F.count(F.lit(1)).alias("__rows"), *[n.alias(c) for c, n in uncastable(declared).items()])
    typed = stage(ods_typed(counted, declared), name)
    found = observed_values(seen)
    bad = {c: n for c, n in found.items() if n and c != "__rows"}
    if bad:
        raise ValueError("values do not convert: " + ", ".join(f"{c}={n}" for c, n in bad.items()))
    return typed


def ods_typed(raw: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Typed projection of an all-text table, source columns in order."""
    return raw.select(*[TRY_CASTS[kind](F.col(c)).alias(c) for c, kind in declared.items()])


def _present(df: DataFrame, columns) -> list[str]:
    return [c for c in columns if c in df.columns]


def coerce_types(df: DataFrame) -> DataFrame:
    """Money and times that do not convert become NULL, codes trimmed text."""
    changes = {c: F.trim(F.col(c).cast("string")).try_cast(MONEY) for c in _present(df, MONEY_COLUMNS)}
    changes |= {
        c: F.trim(F.col(c).cast("string")).try_cast("timestamp_ntz") for c in _present(df, TIME_COLUMNS)
    }
    changes |= {c: F.trim(F.col(c).cast("string")) for c in _present(df, CODE_COLUMNS)}
    return df.withColumns(changes)


def fill_money_zero(df: DataFrame, columns=FILL_COLUMNS) -> DataFrame:
    """Missing or unreadable money becomes 0."""
    zero = F.lit(0).cast(MONEY)
    return df.withColumns(
        {
            c: F.coalesce(F.trim(F.col(c).cast("string")).try_cast(MONEY), zero)
            for c in _present(df, columns)
        }
    )


def trim_text(df: DataFrame) -> DataFrame:
    """Trim every text column; NULL stays NULL."""
    return df.withColumns({n: F.trim(F.col(n)) for n, kind in df.dtypes if kind == "string"})


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Full-row duplicates removed. Copies collapse before the shuffle."""
    return df.dropDuplicates()


def removed_duplicates(df: DataFrame) -> DataFrame:
    """Each duplicated row once, with the number of copies that were removed."""
    counted = df.groupBy(*df.columns).agg((F.count(F.lit(1)) - 1).alias("removed_copies"))
    return counted.filter(F.col("removed_copies") > 0)


def clean_table(raw: DataFrame) -> DataFrame:
    """Deduplicate, fill money, coerce, trim: one plan with one shuffle."""
    return trim_text(coerce_types(fill_money_zero(drop_exact_duplicates(raw))))
