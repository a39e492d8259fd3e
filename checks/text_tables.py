"""All-text copies of the faulty tables, with values that do not convert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import Tables
from martloom.sources import schemas


def _text(df: DataFrame, columns) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(
        *[
            (
                F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kinds[c] == "timestamp_ntz" else F.col(c).cast("string")
            ).alias(c)
            for c in columns
        ]
    )


def text_order(t: Tables) -> DataFrame:
    """Statuses padded with blanks; some amounts unreadable."""
    o = _text(t.faulty.order(), schemas.ORDER)
    key = F.col("order_id").cast("bigint")
    return o.withColumns(
        {
            "order_status": F.concat(F.lit("  "), "order_status", F.lit(" ")),
            "coupon_amount": F.when(key % 83 == 0, F.lit("none")).otherwise(F.col("coupon_amount")),
        }
    )


def text_detail(t: Tables) -> DataFrame:
    """Some quantities, amounts and times unreadable."""
    d = _text(t.faulty.detail(), schemas.ORDER_DETAIL)
    key = F.col("order_id").cast("bigint")
    return d.withColumns(
        {
            "quantity": F.when(key % 109 == 0, F.lit("many")).otherwise(F.col("quantity")),
            "actual_amount": F.when(key % 89 == 0, F.lit("n/a")).otherwise(F.col("actual_amount")),
            "created_at": F.when(key % 83 == 0, F.lit("2025-13-01 00:00:00")).otherwise(F.col("created_at")),
        }
    )


TEXT_SQL = """
text_order AS (
  SELECT order_id, customer_id, '  ' || order_status || ' ' AS order_status,
    strftime(order_time, '%Y-%m-%d %H:%M:%S') AS order_time,
    CASE WHEN CAST(order_id AS BIGINT) % 83 = 0 THEN 'none' ELSE CAST(coupon_amount AS VARCHAR) END AS coupon_amount,
    CAST(payable_amount AS VARCHAR) AS payable_amount
  FROM f_order
),
text_detail AS (
  SELECT order_detail_id, order_id,
    CASE WHEN CAST(order_id AS BIGINT) % 109 = 0 THEN 'many' ELSE CAST(quantity AS VARCHAR) END AS quantity,
    CASE WHEN CAST(order_id AS BIGINT) % 89 = 0 THEN 'n/a' ELSE CAST(actual_amount AS VARCHAR) END AS actual_amount,
    CASE WHEN CAST(order_id AS BIGINT) % 83 = 0 THEN '2025-13-01 00:00:00'
      ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS created_at
  FROM f_detail
)"""


def with_text(body: str) -> str:
    return f"WITH {TEXT_SQL}\n{body}"
