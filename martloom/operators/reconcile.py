"""Checks between layers: source total, target total, difference, verdict."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.functions import fixed
from martloom.functions.columns import beside, count_if
from martloom.operators.sales import is_valid, order_grain

NUMBER = "decimal(38,8)"


def compare(name: str, source: Column, target: Column, tolerance: str = "0") -> Column:
    """One check as a struct; NULL counts as 0."""
    s = F.coalesce(source.cast(NUMBER), F.lit(Decimal(0)))
    t = F.coalesce(target.cast(NUMBER), F.lit(Decimal(0)))
    difference = F.abs(s - t)
    return F.struct(
        F.lit(name).alias("check_name"),
        s.cast(NUMBER).alias("source_value"),
        t.cast(NUMBER).alias("target_value"),
        difference.cast(NUMBER).alias("difference"),
        (difference <= F.lit(Decimal(tolerance))).alias("passed"),
    )


def checks(one_row: DataFrame, structs: list[Column]) -> DataFrame:
    return one_row.select(F.inline(F.array(*structs)))


def compare_metric(
    name: str, source: DataFrame, source_column: str, target: DataFrame, target_column: str, tolerance: str = "0"
) -> DataFrame:
    """Sum of a column on both sides, compared."""
    one = beside(source.agg(F.sum(source_column).alias("s")), target.agg(F.sum(target_column).alias("t")))
    return checks(one, [compare(name, F.col("s"), F.col("t"), tolerance)])


def require_all_passed(result: DataFrame) -> None:
    """Raise with the names of the failed checks (one row per check is fetched)."""
    failed = [r.check_name for r in result.filter(~F.col("passed")).collect()]
    if failed:
        raise ValueError(f"{len(failed)} checks failed: {', '.join(failed)}")


def _sums(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias(f"{prefix}_rows"), *[F.sum(c).alias(f"{prefix}_{c}") for c in columns]
    )


def _repeated(df: DataFrame, key: str, name: str) -> DataFrame:
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(count_if(F.col("n") > 1).alias(name))


# ---- one subject table against its source --------------------------------


def user_sales_checks(orders: DataFrame, users: DataFrame) -> DataFrame:
    one = beside(
        *[
            _sums(orders, "o", "payable_amount"),
            _sums(users, "u", "order_count", "total_amount"),
            _repeated(users, "customer_id", "repeated"),
        ]
    )
    c = F.col
    return checks(
        one,
        [
            compare("user_orders", c("o_rows"), c("u_order_count")),
            compare("user_amount", c("o_payable_amount"), c("u_total_amount"), fixed.MONEY_TOLERANCE),
            compare("user_repeated", F.lit(0), c("repeated")),
        ],
    )


def product_sales_checks(details: DataFrame, products: DataFrame) -> DataFrame:
    one = beside(
        *[
            _sums(details, "d", "quantity", "actual_amount"),
            _sums(products, "p", "sales_detail_count", "sales_count", "sales_amount"),
            _repeated(products, "product_id", "repeated"),
        ]
    )
    c = F.col
    return checks(
        one,
        [
            compare("product_details", c("d_rows"), c("p_sales_detail_count")),
            compare("product_quantity", c("d_quantity"), c("p_sales_count")),
            compare("product_amount", c("d_actual_amount"), c("p_sales_amount"), fixed.MONEY_TOLERANCE),
            compare("product_repeated", F.lit(0), c("repeated")),
        ],
    )


def area_sales_checks(orders: DataFrame, areas: DataFrame) -> DataFrame:
    return _orders_and_money("area", orders, areas)


def daily_sales_checks(orders: DataFrame, daily: DataFrame) -> DataFrame:
    return _orders_and_money("daily", orders, daily)


def _orders_and_money(prefix: str, orders: DataFrame, target: DataFrame) -> DataFrame:
    one = beside(*[_sums(orders, "o", "payable_amount"), _sums(target, "t", "order_count", "sales_amount")])
    c = F.col
    return checks(
        one,
        [
            compare(f"{prefix}_orders", c("o_rows"), c("t_order_count")),
            compare(f"{prefix}_amount", c("o_payable_amount"), c("t_sales_amount"), fixed.MONEY_TOLERANCE),
        ],
    )


def monthly_checks(daily: DataFrame, trend: DataFrame) -> DataFrame:
    last = trend.agg(
        F.max(F.struct("year_month", "cumulative_order_count", "cumulative_sales_amount")).alias("last")
    )
    one = beside(
        *[
            _sums(daily, "d", "order_count", "sales_amount"),
            _sums(trend, "m", "order_count", "sales_amount"),
            _repeated(trend, "year_month", "repeated"),
            last,
        ]
    )
    c = F.col
    return checks(
        one,
        [
            compare("monthly_orders", c("d_order_count"), c("m_order_count")),
            compare("monthly_amount", c("d_sales_amount"), c("m_sales_amount"), fixed.MONEY_TOLERANCE),
            compare("monthly_repeated", F.lit(0), c("repeated")),
            compare("last_running_orders", c("m_order_count"), c("last.cumulative_order_count")),
            compare(
                "last_running_amount",
                c("m_sales_amount"),
                c("last.cumulative_sales_amount"),
                fixed.MONEY_TOLERANCE,
            ),
        ],
    )


# ---- the whole warehouse -------------------------------------------------

# ---- fixed values: names of the checks -----------------------------------
CHECKS_29 = (
    "ODS订单数 → DWD订单数",
    "ODS订单明细数 → DWD明细数",
    "有效客户数 → DWS用户数",
    "有效订单数 → DWS用户订单数",
    "有效订单金额 → DWS用户金额",
    "有效订单数 → DWS地区订单数",
    "有效订单金额 → DWS地区金额",
    "有效日期数 → ADS日销售日期数",
    "有效订单数 → ADS日销售订单数",
    "有效订单金额 → ADS日销售金额",
    "有效订单数 → ADS月度订单数",
    "有效订单金额 → ADS月度销售额",
    "DWS用户数 → RFM基础用户数",
    "RFM基础用户数 → RFM分群用户数",
    "DWS用户金额 → RFM基础金额",
    "RFM基础金额 → RFM分群金额",
    "有效商品数 → DWS商品数",
    "有效商品销量 → DWS商品销量",
    "有效商品金额 → DWS商品金额",
    "DWS商品数 → ADS商品数",
    "DWS商品销量 → ADS商品销量",
    "DWS商品金额 → ADS商品金额",
    "ABC最小排名",
    "ABC最大排名",
    "ABC排名唯一数量",
    "ABC最终累计销售额占比",
    "ABC等级完整性",
    "ADS商品数 → ABC汇总商品数",
    "ADS商品金额 → ABC汇总金额",
)
CHECKS_12 = (
    "DWD有效订单数 → DWS用户订单数",
    "DWD有效订单金额 → DWS用户金额",
    "DWD有效日期订单数 → ADS日销售订单数",
    "DWD有效日期订单金额 → ADS日销售金额",
    "DWS用户数 → ADS用户数",
    "DWS用户订单数 → ADS用户订单数",
    "DWS用户金额 → ADS用户金额",
    "DWD有效商品销量 → DWS商品销量",
    "DWD有效商品金额 → DWS商品金额",
    "DWS商品数 → ADS商品数",
    "DWS商品销量 → ADS商品销量",
    "DWS商品金额 → ADS商品金额",
)
ABC_LETTERS = ("A", "B", "C")


def distinct_set_equality(df: DataFrame, column: str, expected=ABC_LETTERS) -> DataFrame:
    """Whether the distinct first letters of ``column`` are exactly ``expected``.

    Letters are made distinct before they are gathered, so the gathered list
    has one entry per letter.
    """
    letters = df.select(F.substring(column, 1, 1).alias("letter")).distinct()
    wanted = F.array(*[F.lit(x) for x in sorted(expected)])
    found = F.array_sort(F.collect_set("letter"))
    return letters.agg(found.alias("found")).select(
        F.array_join("found", ",").alias("found"), (F.col("found") == wanted).alias("ok")
    )


def order_facts(wide: DataFrame, statuses) -> DataFrame:
    """All source numbers that come from orders, in one row.

    Amounts need order grain. Distinct days do not, so they are counted from
    the wide rows directly: a handful of dates leaves each task.
    """
    columns = ("order_id", "customer_id", "order_time", "order_status", "payable_amount")
    v = F.col("valid")
    dated = v & F.col("dated")
    per_customer = (
        order_grain(wide.select(*columns), columns)
        .select(
            "customer_id", "payable_amount", is_valid(statuses).alias("valid"), F.col("order_time").isNotNull().alias("dated")
        )
        .groupBy("customer_id", "valid", "dated")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("payable_amount").alias("amount"))
        .groupBy("customer_id")
        .agg(
            F.sum("n").alias("all_orders"),
            F.sum(F.when(v, F.col("n"))).alias("valid_orders"),
            F.sum(F.when(v, F.col("amount"))).alias("valid_amount"),
            F.sum(F.when(dated, F.col("n"))).alias("dated_orders"),
            F.sum(F.when(dated, F.col("amount"))).alias("dated_amount"),
        )
    )
    names = ("all_orders", "valid_orders", "valid_amount", "dated_orders", "dated_amount")
    totals = per_customer.agg(
        *[F.sum(n).alias(n) for n in names],
        count_if((F.col("valid_orders") > 0) & F.col("customer_id").isNotNull()).alias("valid_users"),
    )
    days = (
        wide.filter(is_valid(statuses))
        .select(F.to_date("order_time").alias("day"))
        .distinct()
        .agg(F.count("day").alias("valid_days"))
    )
    return beside(totals, days)


def detail_facts(wide: DataFrame, statuses) -> DataFrame:
    v = is_valid(statuses)
    cells = wide.select("product_id", v.alias("valid"), "quantity", "actual_amount").groupBy("product_id", "valid").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"), F.sum("actual_amount").alias("amount")
    )
    valid = F.col("valid")
    return cells.agg(
        F.sum("n").alias("all_details"),
        F.sum(F.when(valid, F.col("quantity"))).alias("valid_quantity"),
        F.sum(F.when(valid, F.col("amount"))).alias("valid_detail_amount"),
        count_if(valid & F.col("product_id").isNotNull()).alias("valid_products"),
    )


def warehouse_checks_29(t: dict[str, DataFrame], statuses) -> DataFrame:
    """The 29 checks over the written layer tables.

    ``t`` holds: ods_order, ods_order_detail, dwd_order_detail, dws_user_sales,
    dws_product_sales, dws_area_sales, ads_sales_summary,
    ads_monthly_sales_trend, ads_user_rfm_base, ads_user_rfm_segment,
    ads_product_abc, ads_product_abc_summary. Each table is aggregated once.
    """
    abc = t["ads_product_abc"]
    letters = abc.select(F.substring("abc_level", 1, 1).alias("l")).distinct().agg(
        F.array_sort(F.collect_set("l")).alias("letters")
    )
    ranks = (
        abc.groupBy("sales_amount_rank")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("sales_count").alias("q"),
            F.sum("sales_amount").alias("a"),
            F.max("cumulative_sales_amount_rate").alias("share"),
        )
        .agg(
            F.sum("n").alias("abc_rows"),
            F.sum("q").alias("abc_quantity"),
            F.sum("a").alias("abc_amount"),
            F.min("sales_amount_rank").alias("min_rank"),
            F.max("sales_amount_rank").alias("max_rank"),
            F.count("sales_amount_rank").alias("ranks"),
            F.max("share").alias("last_share"),
        )
    )
    one = beside(
        *[
            t["ods_order"].agg(F.count(F.lit(1)).alias("ods_orders")),
            t["ods_order_detail"].agg(F.count(F.lit(1)).alias("ods_details")),
            order_facts(t["dwd_order_detail"], statuses),
            detail_facts(t["dwd_order_detail"], statuses),
            _sums(t["dws_user_sales"], "u", "order_count", "total_amount"),
            _sums(t["dws_area_sales"], "a", "order_count", "sales_amount"),
            _sums(t["ads_sales_summary"], "d", "order_count", "sales_amount"),
            _sums(t["ads_monthly_sales_trend"], "m", "order_count", "sales_amount"),
            _sums(t["ads_user_rfm_base"], "rb", "monetary"),
            _sums(t["ads_user_rfm_segment"], "rs", "monetary"),
            _sums(t["dws_product_sales"], "p", "sales_count", "sales_amount"),
            ranks,
            letters,
            _sums(t["ads_product_abc_summary"], "s", "product_count", "sales_amount"),
        ]
    )
    c = F.col
    cent = fixed.MONEY_TOLERANCE
    wanted = F.array(*[F.lit(x) for x in ABC_LETTERS])
    complete = F.when(c("letters") == wanted, F.lit(len(ABC_LETTERS))).otherwise(F.lit(0))
    pairs = [
        (c("ods_orders"), c("all_orders"), "0"),
        (c("ods_details"), c("all_details"), "0"),
        (c("valid_users"), c("u_rows"), "0"),
        (c("valid_orders"), c("u_order_count"), "0"),
        (c("valid_amount"), c("u_total_amount"), cent),
        (c("valid_orders"), c("a_order_count"), "0"),
        (c("valid_amount"), c("a_sales_amount"), cent),
        (c("valid_days"), c("d_rows"), "0"),
        (c("valid_orders"), c("d_order_count"), "0"),
        (c("valid_amount"), c("d_sales_amount"), cent),
        (c("valid_orders"), c("m_order_count"), "0"),
        (c("valid_amount"), c("m_sales_amount"), cent),
        (c("u_rows"), c("rb_rows"), "0"),
        (c("rb_rows"), c("rs_rows"), "0"),
        (c("u_total_amount"), c("rb_monetary"), cent),
        (c("rb_monetary"), c("rs_monetary"), cent),
        (c("valid_products"), c("p_rows"), "0"),
        (c("valid_quantity"), c("p_sales_count"), "0"),
        (c("valid_detail_amount"), c("p_sales_amount"), cent),
        (c("p_rows"), c("abc_rows"), "0"),
        (c("p_sales_count"), c("abc_quantity"), "0"),
        (c("p_sales_amount"), c("abc_amount"), cent),
        (F.lit(1), c("min_rank"), "0"),
        (c("abc_rows"), c("max_rank"), "0"),
        (c("abc_rows"), c("ranks"), "0"),
        (F.lit(1), c("last_share"), "0.0001"),
        (F.lit(len(ABC_LETTERS)), complete, "0"),
        (c("abc_rows"), c("s_product_count"), "0"),
        (c("abc_amount"), c("s_sales_amount"), cent),
    ]
    return checks(one, [compare(n, s, g, tol) for n, (s, g, tol) in zip(CHECKS_29, pairs, strict=True)])


def warehouse_checks_12(t: dict[str, DataFrame], statuses) -> DataFrame:
    """The 12 checks of the order-driven warehouse.

    ``t`` holds: dwd_order_detail, dws_user_sales, dws_product_sales,
    ads_sales_summary, ads_user_summary, ads_product_summary.
    """
    one = beside(
        *[
            order_facts(t["dwd_order_detail"], statuses),
            detail_facts(t["dwd_order_detail"], statuses),
            _sums(t["dws_user_sales"], "u", "order_count", "total_amount"),
            _sums(t["ads_sales_summary"], "d", "order_count", "sales_amount"),
            _sums(t["ads_user_summary"], "au", "order_count", "total_amount"),
            _sums(t["dws_product_sales"], "p", "sales_count", "sales_amount"),
            _sums(t["ads_product_summary"], "ap", "sales_count", "sales_amount"),
        ]
    )
    c = F.col
    cent = fixed.MONEY_TOLERANCE
    pairs = [
        (c("valid_orders"), c("u_order_count"), "0"),
        (c("valid_amount"), c("u_total_amount"), cent),
        (c("dated_orders"), c("d_order_count"), "0"),
        (c("dated_amount"), c("d_sales_amount"), cent),
        (c("u_rows"), c("au_rows"), "0"),
        (c("u_order_count"), c("au_order_count"), "0"),
        (c("u_total_amount"), c("au_total_amount"), cent),
        (c("valid_quantity"), c("p_sales_count"), "0"),
        (c("valid_detail_amount"), c("p_sales_amount"), cent),
        (c("p_rows"), c("ap_rows"), "0"),
        (c("p_sales_count"), c("ap_sales_count"), "0"),
        (c("p_sales_amount"), c("ap_sales_amount"), cent),
    ]
    return checks(one, [compare(n, s, g, tol) for n, (s, g, tol) in zip(CHECKS_12, pairs, strict=True)])


# ---- fixed values: names of the row-parity pairs -------------------------
PARITY_PAIRS = (
    ("DWD订单明细 → BI订单明细", "dwd_order_detail", "fact_order_detail"),
    ("DWS用户主题 → ADS RFM用户", "dws_user_sales", "ads_user_rfm_segment"),
    ("DWS商品主题 → ADS商品指标", "dws_product_sales", "ads_product_abc"),
    ("ADS日销售日期 → BI日期维度", "ads_sales_summary", "dim_date"),
)


def layer_row_parity(t: dict[str, DataFrame]) -> DataFrame:
    """Row counts that should agree. The last pair can differ rightly: the date
    dimension covers all orders, daily sales only valid ones."""
    names = sorted({n for _, a, b in PARITY_PAIRS for n in (a, b)})
    one = beside(*[t[n].agg(F.count(F.lit(1)).alias(n)) for n in names])
    return checks(one, [compare(label, F.col(a), F.col(b)) for label, a, b in PARITY_PAIRS])
