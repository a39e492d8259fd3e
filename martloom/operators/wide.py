"""The order-detail wide table and the checks around its joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.functions import fixed
from martloom.functions.columns import beside, count_if, half_up, instant, with_etl_columns
from martloom.session import stage

# ---- fixed values: wide-table columns, (source column, output name) -------
DETAIL_PART = (
    ("order_detail_id", "order_detail_id"),
    ("order_id", "order_id"),
    ("product_id", "product_id"),
    ("quantity", "quantity"),
    ("unit_price", "unit_price"),
    ("discount_amount", "discount_amount"),
    ("actual_amount", "actual_amount"),
    ("created_at", "detail_created_at"),
)
ORDER_PART = (
    ("order_no", "order_no"),
    ("customer_id", "customer_id"),
    ("shop_id", "shop_id"),
    ("order_time", "order_time"),
    ("order_status", "order_status"),
    ("order_amount", "order_amount"),
    ("coupon_amount", "coupon_amount"),
    ("freight_amount", "freight_amount"),
    ("payable_amount", "payable_amount"),
    ("order_channel", "order_channel"),
    ("receiver_province_code", "receiver_province_code"),
    ("receiver_province_name", "receiver_province_name"),
    ("updated_at", "order_updated_at"),
)
CUSTOMER_PART = (
    ("customer_name", "customer_name"),
    ("gender", "gender"),
    ("age", "age"),
    ("phone", "phone"),
    ("email", "email"),
    ("member_level", "member_level"),
    ("customer_status", "customer_status"),
    ("province_code", "customer_province_code"),
    ("province_name", "customer_province_name"),
    ("register_time", "customer_register_time"),
)
PRODUCT_PART = (
    ("product_name", "product_name"),
    ("category_id", "category_id"),
    ("category_name", "category_name"),
    ("brand_name", "brand_name"),
    ("unit_price", "product_standard_price"),
    ("cost_price", "cost_price"),
    ("product_status", "product_status"),
)
# ---- fixed values: columns of the order-driven wide table ----------------
ORDER_DRIVEN_COLUMNS = (
    "order_id",
    "order_no",
    "customer_id",
    "shop_id",
    "order_time",
    "order_status",
    "order_channel",
    "order_amount",
    "coupon_amount",
    "freight_amount",
    "payable_amount",
    "receiver_province_code",
    "receiver_province_name",
    "customer_name",
    "member_level",
    "order_detail_id",
    "product_id",
    "quantity",
    "unit_price",
    "discount_amount",
    "actual_amount",
    "created_at",
    "product_name",
    "category_name",
)
#: Written details that are joined at one time; their joins shuffle about six times as much.
PART_BYTES = 3 << 30
#: Rows to the same rows with other columns.
Rows = Callable[[DataFrame], DataFrame]
MEMBER_FOUND = ("order_found", "customer_found", "product_found")


def _pick(df: DataFrame, part, key: str, key_as: str) -> DataFrame:
    return df.select(F.col(key).alias(key_as), *[F.col(a).alias(b) for a, b in part])


def joined(detail: DataFrame, order: DataFrame, customer: DataFrame, product: DataFrame, derive: Rows | None = None) -> DataFrame:
    """Details with everything they point at; no detail is lost.

    Customers meet the orders, of which there are several times fewer, before
    both meet the details, so detail rows are dealt out for two joins at most.
    A product table too large to broadcast comes first: it adds less to a row that
    is dealt out again than orders and customers do.
    All are plain left joins: Spark broadcasts a side while its measured size is
    under its threshold, and otherwise sort-merges with skewed keys split.
    ``derive`` makes the detail columns of the joined rows, where ``detail`` holds
    only their keys and source columns; what is long is not dealt out then.
    ``*_found`` tells a missing partner from one whose attributes are NULL.
    """
    o = _pick(order, ORDER_PART, "order_id", "o_order_id")
    c = _pick(customer, CUSTOMER_PART, "customer_id", "c_customer_id")
    p = _pick(product, PRODUCT_PART, "product_id", "p_product_id")
    d = detail if derive else detail.select(*[F.col(a).alias(b) for a, b in DETAIL_PART])
    bought = o.join(c, F.col("customer_id") == F.col("c_customer_id"), "left")
    joins = [
        (bought, F.col("order_id") == F.col("o_order_id")),
        (p, F.col("product_id") == F.col("p_product_id")),
    ]
    if written_bytes(p) > fixed.BROADCAST_MB << 20:
        joins.reverse()
    for side, on in joins:
        d = d.join(side, on, "left")
    details = [(b, b) for _, b in DETAIL_PART]
    if derive:
        d, details = derive(d), DETAIL_PART
    return d.select(
        *[F.col(a).alias(b) for a, b in details],
        *[b for part in (ORDER_PART, CUSTOMER_PART, PRODUCT_PART) for _, b in part],
        F.col("o_order_id").isNotNull().alias("order_found"),
        F.col("c_customer_id").isNotNull().alias("customer_found"),
        F.col("p_product_id").isNotNull().alias("product_found"),
    )


def dwd_wide(detail: DataFrame, order: DataFrame, customer: DataFrame, product: DataFrame, derive: Rows | None = None) -> DataFrame:
    """The wide table: 38 business columns and three technical ones."""
    return with_etl_columns(joined(detail, order, customer, product, derive).drop(*MEMBER_FOUND))


def parts_by_order(order: DataFrame, detail: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Written orders and details in parts of some ``PART_BYTES`` of details, the same orders in both.

    The parts' joins on order add up to the join of the whole, so a wide table can be joined and written part by part:
    what is shuffled at one time is a part's share. Each part reads both tables. A part is a hash of the order id, where
    missing ids have one part too. Ids of two types, which a join would compare after a cast, stay in one part.
    """
    n = -(-written_bytes(detail) // PART_BYTES)
    if n <= 1 or order.schema["order_id"].dataType != detail.schema["order_id"].dataType:
        return [(order, detail)]
    place = F.pmod(F.xxhash64("order_id"), F.lit(n))
    return [(order.where(place == i), detail.where(place == i)) for i in range(n)]


def dwd_wide_parts(detail: DataFrame, order: DataFrame, customer: DataFrame, product: DataFrame) -> list[DataFrame]:
    """``dwd_wide`` in the parts of ``parts_by_order``, of one load time."""
    at = instant()
    return [
        with_etl_columns(joined(d, o, customer, product).drop(*MEMBER_FOUND), at=at)
        for o, d in parts_by_order(order, detail)
    ]


def dwd_join_audit(detail: DataFrame, order: DataFrame, customer: DataFrame, product: DataFrame) -> DataFrame:
    """Rows before and after joining, repeated details, missing partners.

    Only keys are read. The distinct count is a group by detail id, so it
    spreads evenly; the other numbers ride along in the same pass.
    """
    d = detail.select("order_detail_id", "order_id", "product_id")
    o = order.select(F.col("order_id").alias("o_id"), "customer_id")
    c = customer.select(F.col("customer_id").alias("c_id"))
    p = product.select(F.col("product_id").alias("p_id"))
    bought = o.join(c, F.col("customer_id") == F.col("c_id"), "left")
    per_detail = (
        d.join(bought, d.order_id == F.col("o_id"), "left")
        .join(p, F.col("product_id") == F.col("p_id"), "left")
        .groupBy("order_detail_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            count_if(F.col("o_id").isNull()).alias("no_order"),
            count_if(F.col("c_id").isNull()).alias("no_customer"),
            count_if(F.col("p_id").isNull()).alias("no_product"),
        )
    )
    after = per_detail.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("joined_rows"),
        F.coalesce(F.sum("n") - F.count("order_detail_id"), F.lit(0)).alias("repeated_rows"),
        F.coalesce(F.sum("no_order"), F.lit(0)).alias("missing_order_rows"),
        F.coalesce(F.sum("no_customer"), F.lit(0)).alias("missing_customer_rows"),
        F.coalesce(F.sum("no_product"), F.lit(0)).alias("missing_product_rows"),
    )
    before = detail.agg(F.count(F.lit(1)).alias("source_rows"))
    return beside(before, after)


def dwd_order_driven(order: DataFrame, detail: DataFrame, customer: DataFrame, product: DataFrame) -> DataFrame:
    """Orders first: keeps orders without details, drops details without order.

    As in ``joined``, a product table too large to broadcast meets the details before the orders do.
    """
    o = order.select(*[a for a in ("order_id", *[x for x, _ in ORDER_PART]) if a != "updated_at"])
    d = detail.select(F.col("order_id").alias("d_order_id"), *[a for a, _ in DETAIL_PART if a != "order_id"])
    c = customer.select(F.col("customer_id").alias("c_id"), "customer_name", "member_level")
    p = product.select(F.col("product_id").alias("p_id"), "product_name", "category_name")
    bought, sold = o.join(c, F.col("customer_id") == F.col("c_id"), "left"), F.col("product_id") == F.col("p_id")
    if written_bytes(p) > fixed.BROADCAST_MB << 20:
        rows = bought.join(d.join(p, sold, "left"), F.col("order_id") == F.col("d_order_id"), "left")
    else:
        rows = bought.join(d, F.col("order_id") == F.col("d_order_id"), "left").join(p, sold, "left")
    return rows.select(*ORDER_DRIVEN_COLUMNS)


def dwd_order_driven_parts(order: DataFrame, detail: DataFrame, customer: DataFrame, product: DataFrame) -> list[DataFrame]:
    """``dwd_order_driven`` in the parts of ``parts_by_order``."""
    return [dwd_order_driven(o, d, customer, product) for o, d in parts_by_order(order, detail)]


def detail_cardinality(detail: DataFrame) -> DataFrame:
    """Orders with several details, and the largest number of details."""
    return (
        detail.groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("details"))
        .agg(
            count_if(F.col("details") > 1).alias("multi_detail_orders"),
            F.max("details").alias("max_details"),
        )
    )


def written_bytes(table: DataFrame) -> int:
    """Size of a written table, from the listing of its files."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def left_join_outcome(detail: DataFrame, keys: DataFrame, strategy: str) -> DataFrame:
    """Rows and unmatched rows of detail left join product keys (``p_id``) under one strategy: merge, broadcast or shuffle_hash."""
    right = F.broadcast(keys) if strategy == "broadcast" else keys.hint(strategy)
    return (
        detail.select("product_id")
        .join(right, F.col("product_id") == F.col("p_id"), "left")
        .agg(F.count(F.lit(1)).alias("joined_rows"), count_if(F.col("p_id").isNull()).alias("unmatched_rows"))
        .select(F.lit(strategy).alias("strategy"), "joined_rows", "unmatched_rows")
    )


def join_strategy_equivalence(detail: DataFrame, product: DataFrame, most_bytes: int = fixed.BROADCAST_MB << 20) -> DataFrame:
    """Sort-merge join against a broadcast of the product keys.

    The keys are written first and broadcast only if their files are small
    enough; larger ones are compared with a shuffled hash join instead.
    """
    keys = stage(product.select(F.col("product_id").alias("p_id")), "product-keys")
    other = "broadcast" if written_bytes(keys) <= most_bytes else "shuffle_hash"
    return left_join_outcome(detail, keys, "merge").unionByName(left_join_outcome(detail, keys, other))


# ---- order / detail fan-out ---------------------------------------------
# Joining orders to their details repeats each order once per detail. All the
# numbers about that follow from the detail count per order, so details are
# counted before the join and the repeated rows are never produced.


def details_per_order(detail: DataFrame) -> DataFrame:
    return detail.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("detail_count"),
        F.sum("quantity").alias("total_quantity"),
        F.sum("actual_amount").alias("detail_amount"),
    )


def join_row_expansion(order: DataFrame, detail: DataFrame) -> DataFrame:
    orders = order.select("order_id").groupBy("order_id").agg(F.count(F.lit(1)).alias("order_copies"))
    details = detail.groupBy("order_id").agg(F.count(F.lit(1)).alias("detail_copies"))
    both = orders.join(details, "order_id", "full")
    return both.agg(
        F.sum("order_copies").alias("order_rows"),
        F.count("order_copies").alias("order_count"),
        F.sum("detail_copies").alias("detail_rows"),
        F.count("detail_copies").alias("detail_order_count"),
        F.sum(F.col("order_copies") * F.col("detail_copies")).alias("join_rows"),
        F.count(F.col("order_copies") * F.col("detail_copies")).alias("join_order_count"),
    )


def _fan_out(order: DataFrame, detail: DataFrame, *columns: str) -> DataFrame:
    """Orders with ``repeated``: the amount they would add after the join."""
    counts = detail.groupBy("order_id").agg(F.count(F.lit(1)).alias("detail_count"))
    return (
        order.select("order_id", "payable_amount", *columns)
        .join(counts, "order_id", "left")
        .withColumn("repeated", F.col("payable_amount") * F.col("detail_count"))
    )


def _ratio(num: str, den: str, scale: int) -> Column:
    return half_up(F.col(num), F.col(den), scale)


def amount_duplication(order: DataFrame, detail: DataFrame) -> DataFrame:
    return (
        _fan_out(order, detail)
        .agg(
            F.sum("payable_amount").alias("correct_order_amount"),
            F.sum("repeated").cast("decimal(38,2)").alias("wrong_joined_amount"),
        )
        .withColumns(
            {
                "repeated_amount": F.col("wrong_joined_amount") - F.col("correct_order_amount"),
                "amplification_ratio": _ratio("wrong_joined_amount", "correct_order_amount", 4),
            }
        )
    )


def channel_wrong_vs_correct(order: DataFrame, detail: DataFrame, statuses) -> DataFrame:
    """Per channel, highest ratio first. Channels without any detail drop out."""
    return (
        _fan_out(order.filter(F.col("order_status").isin(*statuses)), detail, "order_channel")
        .groupBy("order_channel")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.sum("payable_amount").alias("correct_sales_amount"),
            F.sum("repeated").cast("decimal(38,2)").alias("wrong_sales_amount"),
            F.count("detail_count").alias("with_detail"),
        )
        .filter((F.col("with_detail") > 0) & F.col("order_channel").isNotNull())
        .drop("with_detail")
        .withColumns(
            {
                "repeated_amount": F.col("wrong_sales_amount") - F.col("correct_sales_amount"),
                "amplification_ratio": _ratio("wrong_sales_amount", "correct_sales_amount", 4),
            }
        )
        .orderBy(F.desc("amplification_ratio"), "order_channel")
    )


def channel_metrics(order: DataFrame, detail: DataFrame, statuses) -> DataFrame:
    """Details are summed per order first, so each order meets one row."""
    per_order = details_per_order(detail)
    return (
        order.filter(F.col("order_status").isin(*statuses))
        .select("order_id", "order_channel", "payable_amount")
        .join(per_order, "order_id", "left")
        .groupBy("order_channel")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.sum("payable_amount").alias("sales_amount"),
            F.sum("total_quantity").alias("sales_quantity"),
            F.sum("detail_amount").alias("detail_amount"),
        )
        .withColumn("avg_order_amount", _ratio("sales_amount", "order_count", 2))
        .orderBy(F.desc("sales_amount"), "order_channel")
    )


def restored_grain_totals(order: DataFrame, detail: DataFrame) -> DataFrame:
    """Totals over orders that have details, each order counted once."""
    per_order = detail.groupBy("order_id").agg(F.count(F.lit(1)).alias("detail_count"))
    orders = order.groupBy("order_id").agg(F.max("payable_amount").alias("payable_amount"))
    return (
        per_order.join(orders, "order_id")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.sum("payable_amount").alias("restored_order_amount"),
            F.sum("detail_count").alias("detail_count"),
        )
    )


def top_orders_by_details(order: DataFrame, detail: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` orders with most details; ties go to the smaller order id.

    Orders are looked up for the whole per-order table by a join, not by a
    broadcast of ids, so a detail without order can never take a place.
    """
    return (
        details_per_order(detail)
        .join(order.select("order_id", "payable_amount"), "order_id")
        .select("order_id", "payable_amount", "detail_count", "total_quantity", "detail_amount")
        .orderBy(F.desc("detail_count"), "order_id")
        .limit(n)
    )
