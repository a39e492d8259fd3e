"""Reusable column expressions, all evaluated in the JVM."""

from __future__ import annotations

import time
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.functions import fixed

MONEY = "decimal(18,2)"


def money(c: Column) -> Column:
    return c.cast(MONEY)


def is_blank(name: str) -> Column:
    """NULL, or nothing left after trimming."""
    c = F.col(name)
    return c.isNull() | (F.trim(c.cast("string")) == "")


def try_int(c: Column) -> Column:
    return F.trim(c).try_cast("int")


def try_money(c: Column) -> Column:
    return F.trim(c).try_cast(MONEY)


def try_time(c: Column) -> Column:
    """Wall-clock time in the one accepted text format, else NULL."""
    text = F.trim(c)
    return F.when(text.rlike(fixed.TIME_PATTERN), text.try_cast("timestamp_ntz"))


TRY_CASTS = {"int": try_int, "money": try_money, "time": try_time, "string": lambda c: c}


def half_up(num: Column, den: Column, scale: int, digits: int = 2) -> Column:
    """``num / den`` rounded half away from zero to ``scale`` decimals, exactly.

    Decimal division keeps a limited number of digits, so rounding its result
    can round twice. Whole-number division of ``2*|n|*10^s + d`` by ``2*d``
    rounds once. NULL when ``den`` is zero or NULL. ``num`` and ``den`` must be
    decimals or integers of at most ``digits`` decimals: a value with more stops
    the job instead of being cut. The quotient times ``10^scale`` must fit a bigint.
    """

    def exact_digits(c: Column) -> Column:
        cut = F.abs(c).cast(f"decimal(38,{digits})")
        # Compared in a narrower type: two wide decimals meet in one with fewer decimals.
        over = F.abs(c) != cut.cast(f"decimal(30,{digits})")
        return F.when(over, F.raise_error(F.lit(f"half_up: over {digits} decimals")).cast(f"decimal(38,{digits})")).otherwise(cut)

    n, d = exact_digits(num), exact_digits(den)
    shift = F.lit(Decimal(2 * 10**scale))
    whole = F.call_function("div", n * shift + d, d * F.lit(Decimal(2)))
    sign = F.when((num < 0) != (den < 0), F.lit(-1)).otherwise(F.lit(1))
    step = F.lit(Decimal(1).scaleb(-scale))
    exact = (whole * sign).cast("decimal(20,0)") * step
    return F.when(den != 0, exact.cast(f"decimal(28,{scale})"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def count_if(condition: Column) -> Column:
    """Rows where ``condition`` holds; 0 rather than NULL on empty input."""
    return F.count(F.when(condition, F.lit(1)))


def with_etl_columns(df: DataFrame, source: str = fixed.SOURCE_SYSTEM, at: Column | None = None) -> DataFrame:
    """Technical columns; ``current_timestamp`` is one instant per query, ``at`` one for several."""
    at = F.current_timestamp() if at is None else at
    return df.withColumns(
        {
            "etl_time": at,
            "source_system": F.lit(source),
            "etl_batch": F.date_format(at, fixed.BATCH_FORMAT),
        }
    )


def instant() -> Column:
    """Now, as a constant that several queries can share."""
    return F.timestamp_micros(F.lit(time.time_ns() // 1000))


def meets(left: str, right: str) -> Column:
    """Join condition between rows and a table already grouped on ``right``.

    A plain equality would reuse the grouping's partitioning, and then the
    join has no exchange of its own for Spark to split when one key is hot.
    Null-safe equality hashes another expression, so it gets one. ``right``
    must hold no NULL, which keeps the meaning that of plain equality.
    """
    return F.col(left).eqNullSafe(F.col(right))


def beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Put one-row frames next to each other.

    Each of the others becomes a scalar subquery, so the frames run side by
    side and only their single rows meet; there is no join.
    """
    rows = {f"__row{i}": o.select(F.struct(*o.columns)).scalar() for i, o in enumerate(others)}
    return first.withColumns(rows).select(*first.columns, *[f"{name}.*" for name in rows])


def to_rows(one_row: DataFrame, labels: dict[str, Column], name: str, value: str) -> DataFrame:
    """Turn one wide row of numbers into one row per label."""
    pairs = [F.struct(F.lit(k).alias(name), v.alias(value)) for k, v in labels.items()]
    return one_row.select(F.inline(F.array(*pairs)))
