"""The four warehouse tables, read from an order / line-item style schema.

``RetailTables`` maps ``orders lineitem customer part nation`` Parquet files to
the order, order-detail, customer and product tables. ``FaultyTables`` is the
same data with documented faults put in by fixed expressions, for the quality
jobs.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.functions.columns import money

# ---- fixed values: order states of this schema ---------------------------
ALL_STATUSES = ("F", "O", "P")
VALID_STATUSES = ("O", "F")
PENDING_STATUS = "P"


def derived_detail(rows: DataFrame) -> DataFrame:
    """``detail_source`` rows, or a join of them, as details; columns of other tables follow.

    The id is built from the row's own columns: whole rows are unique, so no
    numbering (and no shuffle) is needed. Called after the joins and exchanges,
    it keeps the long id and the amounts out of them.
    """
    gross = money(F.col("l_extendedprice"))
    discount = money(
        F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)")
    )
    quantity = F.col("l_quantity")
    # Price per piece rounded half up, in whole cents: long arithmetic, once per row.
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    unit_cents = F.when(quantity > 0, F.call_function("div", cents * 2 + quantity, quantity * 2))
    source = ("order_id", "product_id", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    return rows.select(
        F.concat_ws(
            "-",
            "order_id",
            "l_linenumber",
            "product_id",
            "l_suppkey",
            quantity.cast("string"),
            F.date_format(F.to_date("l_shipdate"), "yyyyMMdd"),
        ).alias("order_detail_id"),
        "order_id",
        "product_id",
        quantity.alias("quantity"),
        money(unit_cents / 100).alias("unit_price"),
        discount.alias("discount_amount"),
        money(gross - discount).alias("actual_amount"),
        F.col("l_shipdate").alias("created_at"),
        gross.alias("gross_amount"),
        *[c for c in rows.columns if c not in source],
    )


class RetailTables:
    statuses = VALID_STATUSES

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def areas(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("area_key"), F.col("n_name").alias("area_name")
        )

    def order(self, with_area: bool = False) -> DataFrame:
        """One row per order. The delivery area costs a join, so it is optional."""
        o = self.raw("orders")
        area_code = area_name = F.lit(None).cast("string")
        if with_area:
            home = (
                self.raw("customer")
                .join(self.areas(), F.col("c_nationkey") == F.col("area_key"), "left")
                .select("c_custkey", "c_nationkey", "area_name")
            )
            o = o.join(home, o.o_custkey == home.c_custkey, "left")
            area_code = F.col("c_nationkey").cast("string")
            area_name = F.col("area_name")
        payable = money(F.col("o_totalprice"))
        coupon = money((F.col("o_orderkey") % 3) * 10)
        freight = money((F.col("o_orderkey") % 4) * 4)
        return o.select(
            F.col("o_orderkey").alias("order_id"),
            F.concat(F.lit("NO"), F.col("o_orderkey")).alias("order_no"),
            F.col("o_custkey").alias("customer_id"),
            F.lit(None).cast("string").alias("shop_id"),
            F.col("o_orderdate").alias("order_time"),
            F.col("o_orderstatus").alias("order_status"),
            money(payable + coupon - freight).alias("order_amount"),
            coupon.alias("coupon_amount"),
            freight.alias("freight_amount"),
            payable.alias("payable_amount"),
            F.col("o_orderpriority").alias("order_channel"),
            area_code.alias("receiver_province_code"),
            area_name.alias("receiver_province_name"),
            F.col("o_orderdate").alias("updated_at"),
        )

    def detail_source(self) -> DataFrame:
        """One row per order line: its keys and the columns that ``derived_detail`` takes. Narrow, for joins and exchanges."""
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            "l_linenumber",
            "l_suppkey",
            F.col("l_quantity").cast("int").alias("l_quantity"),
            "l_extendedprice",
            "l_discount",
            "l_shipdate",
        )

    def detail(self) -> DataFrame:
        """One row per order line, with its derived columns."""
        return derived_detail(self.detail_source())

    def customer(self) -> DataFrame:
        nothing = F.lit(None)
        return (
            self.raw("customer")
            .join(self.areas(), F.col("c_nationkey") == F.col("area_key"), "left")
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.col("c_name").alias("customer_name"),
                nothing.cast("string").alias("gender"),
                nothing.cast("int").alias("age"),
                nothing.cast("string").alias("phone"),
                nothing.cast("string").alias("email"),
                nothing.cast("timestamp_ntz").alias("register_time"),
                F.col("c_mktsegment").alias("member_level"),
                F.col("c_nationkey").cast("string").alias("province_code"),
                F.col("area_name").alias("province_name"),
                nothing.cast("string").alias("customer_status"),
                nothing.cast("timestamp_ntz").alias("updated_at"),
            )
        )

    def product(self) -> DataFrame:
        nothing = F.lit(None)
        price = money(F.col("p_retailprice"))
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category_id"),
            F.col("p_type").alias("category_name"),
            F.col("p_brand").alias("brand_name"),
            price.alias("unit_price"),
            money(price * F.lit(Decimal("0.6"))).alias("cost_price"),
            nothing.cast("string").alias("product_status"),
            nothing.cast("timestamp_ntz").alias("created_at"),
            nothing.cast("timestamp_ntz").alias("updated_at"),
        )


def _hit(key: str, modulus: int):
    return F.col(key) % modulus == 0


class FaultyTables(RetailTables):
    """Keys become text and each documented fault hits a fixed part of the keys."""

    def order(self, with_area: bool = False) -> DataFrame:
        o = super().order(with_area).withColumns(
            {
                "order_amount": money(
                    F.col("order_amount")
                    + F.when(_hit("order_id", 97), F.lit(Decimal("1.00"))).otherwise(
                        F.lit(Decimal("0.00"))
                    )
                ),
                "order_status": F.when(_hit("order_id", 101), F.lit("X")).otherwise(
                    F.col("order_status")
                ),
                "customer_id": F.when(_hit("order_id", 103), F.lit("C_MISSING")).otherwise(
                    F.col("customer_id").cast("string")
                ),
            }
        )
        o = o.unionByName(o.filter(_hit("order_id", 131)))
        return o.withColumn("order_id", F.col("order_id").cast("string"))

    def detail(self) -> DataFrame:
        return super().detail().withColumns(
            {
                "actual_amount": money(
                    F.col("actual_amount")
                    + F.when(_hit("order_id", 89), F.lit(Decimal("1.00"))).otherwise(
                        F.lit(Decimal("0.00"))
                    )
                ),
                "quantity": F.when(_hit("order_id", 109), F.lit(-1)).otherwise(F.col("quantity")),
                "product_id": F.when(_hit("order_id", 107), F.lit("P_MISSING")).otherwise(
                    F.col("product_id").cast("string")
                ),
                "order_id": F.col("order_id").cast("string"),
            }
        )

    def customer(self) -> DataFrame:
        return super().customer().withColumns(
            {
                "customer_name": F.when(~_hit("customer_id", 113), F.col("customer_name")),
                "customer_id": F.col("customer_id").cast("string"),
            }
        )

    def product(self) -> DataFrame:
        return super().product().withColumns(
            {
                "category_name": F.when(~_hit("product_id", 127), F.col("category_name")),
                "product_id": F.col("product_id").cast("string"),
            }
        )
