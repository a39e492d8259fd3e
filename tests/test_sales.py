"""Hand-made frames: ties, blanks, missing months, versions, rounding."""

from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from martloom.functions.columns import half_up
from martloom.operators import sales, skew, versions, wide


def test_half_up_rounds_once(spark):
    df = spark.createDataFrame(
        [(D("1.25"), 2), (D("-1.25"), 2), (D("0.01"), 8), (D("2.00"), 0), (None, 3)], "n decimal(18,2), d bigint"
    )
    got = [r[0] for r in df.select(half_up(F.col("n"), F.col("d"), 2)).collect()]
    assert got == [D("0.63"), D("-0.63"), D("0.00"), None, None]


def monthly(spark, data):
    return spark.createDataFrame(
        [(m, int(m[:4]), int(m[5:]), 1, n, D(a), D(0), D(0), D(0)) for m, n, a in data],
        "year_month string, year int, month int, sales_days bigint, order_count bigint, sales_amount decimal(18,2), "
        "coupon_amount decimal(18,2), freight_amount decimal(18,2), avg_order_amount decimal(18,2)",
    )


def test_growth_is_null_without_or_with_zero_previous(spark):
    df = sales.monthly_trend(monthly(spark, [("2025-01", 0, "0"), ("2025-02", 4, "30"), ("2025-03", 3, "20")]))
    got = [(r.order_count_mom_rate, r.sales_amount_mom_rate, r.cumulative_order_count) for r in df.orderBy("year_month").collect()]
    assert got == [(None, None, 0), (None, None, 4), (D("-0.2500"), D("-0.3333"), 7)]


def test_daily_gap(spark):
    days = spark.createDataFrame([("2025-01-01",), ("2025-01-02",), ("2025-01-05",), ("2025-01-05",)], "d string").select(
        F.to_date("d").alias("order_date")
    )
    r = sales.daily_gap_check(days).first()
    assert (r.expected_days, r.missing_days, r.repeated_days) == (5, 1, 1)


def orders(spark, data):
    return spark.createDataFrame(
        data, "order_id string, customer_id string, order_status string, order_time timestamp_ntz, payable_amount decimal(18,2)"
    )


T1, T2 = datetime(2025, 1, 1, 10), datetime(2025, 1, 2, 10)


def test_user_sales_keeps_null_customer_and_shows_split_customer(spark):
    o = orders(spark, [("o1", "c1", "x", T1, D(10)), ("o2", "c1", "x", T2, D(5)), ("o3", None, "x", T2, D(7))])
    c = spark.createDataFrame(
        [("c1", "A"), ("c1", "B")], "customer_id string, customer_name string"
    ).withColumns({k: F.lit(None).cast("string") for k in ("gender", "age", "member_level", "province_code", "province_name")})
    got = sorted((str(r.customer_id), str(r.customer_name), r.order_count, r.total_amount) for r in sales.user_sales(o, c).collect())
    assert got == [("None", "None", 1, D("7.00")), ("c1", "A", 2, D("15.00")), ("c1", "B", 2, D("15.00"))]


def test_order_grain_is_independent_of_row_order(spark):
    data = [("o1", 1, "y"), ("o1", 1, "y"), ("o2", 3, "c"), ("o1", 1, "y")]
    schema = "order_id string, v int, w string"
    a = sales.order_grain(spark.createDataFrame(data, schema), ("order_id", "v", "w")).collect()
    b = sales.order_grain(spark.createDataFrame(data[::-1], schema).repartition(3), ("order_id", "v", "w")).collect()
    assert sorted(a) == sorted(b) == [("o1", 1, "y"), ("o2", 3, "c")]


def test_blank_areas_get_a_name(spark):
    df = spark.createDataFrame([(None, " "), ("11", "北京市")], "receiver_province_code string, receiver_province_name string")
    assert [tuple(r) for r in sales.unknown_areas(df).collect()] == [("UNKNOWN", "未知地区"), ("11", "北京市")]


@pytest.mark.parametrize(
    "amount,level", [("4999.99", "普通用户"), ("5000", "重点用户"), ("9999.99", "重点用户"), ("10000", "VIP"), (None, "普通用户")]
)
def test_user_level_limits(spark, amount, level):
    df = spark.createDataFrame([(None if amount is None else D(amount),)], "total_amount decimal(18,2)")
    assert sales.user_level(df).first().user_level == level


def test_latest_version_with_equal_times(spark):
    schema = "k string, v int, record_update_time timestamp_ntz, record_source string"
    base = spark.createDataFrame([("a", 1, T1, "ORIGINAL"), ("b", 1, T2, "ORIGINAL"), ("c", 1, T1, "ORIGINAL")], schema)
    delta = spark.createDataFrame([("a", 2, T1, "CORRECTED"), ("b", 2, T1, "CORRECTED"), ("d", 2, T1, "CORRECTED")], schema)
    got = sorted((r.k, r.v) for r in versions.latest_version(base, delta, "k").collect())
    # equal time: the greater source name wins
    assert got == [("a", 1), ("b", 1), ("c", 1), ("d", 2)]


def test_salted_equals_plain_for_hot_and_null_keys(spark):
    i = F.col("id")
    key = F.when(i % 3 == 0, "hot").when(i % 11 == 0, None).otherwise(F.concat(F.lit("k"), (i % 97).cast("string")))
    df = spark.range(3000).select("id", key.alias("k"), F.lit(1).alias("v"))
    plain = df.groupBy("k").agg(F.count(F.lit(1)).alias("row_count"), F.sum("v").alias("total_amount"))
    got = skew.salted_aggregate(df, "k", "v", "id")
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert skew.hot_keys(df, "k").count() <= skew.HOT_KEY_LIMIT


def test_skew_audit_verdicts(spark):
    hot = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("k"))
    assert skew.key_skew_audit(hot, "k").first().verdict == "hot"
    assert skew.key_skew_audit(hot.filter("k > 0"), "k").first().verdict == "even"
    assert skew.key_skew_audit(hot.filter("false"), "k").first().verdict == "even"


def test_join_expansion_with_orphans_on_both_sides(spark):
    o = spark.createDataFrame([("o1",), ("o2",), ("o3",)], "order_id string")
    d = spark.createDataFrame([("o1",), ("o1",), ("o2",), ("o9",)], "order_id string")
    assert tuple(wide.join_row_expansion(o, d).first()) == (3, 3, 4, 3, 3, 2)


def test_order_driven_wide_keeps_orders_without_details(spark):
    o = orders(spark, [("o1", "c1", "x", T1, D(1)), ("o2", "c9", "x", T1, D(1))]).withColumns(
        {
            c: F.lit(None).cast("string")
            for c in ("order_no", "shop_id", "order_channel", "order_amount", "coupon_amount", "freight_amount",
                      "receiver_province_code", "receiver_province_name")
        }
    )
    d = spark.createDataFrame(
        [("d1", "o1", "p1", 1), ("d2", "o9", "p1", 1)], "order_detail_id string, order_id string, product_id string, quantity int"
    ).withColumns({c: F.lit(None).cast("string") for c in ("unit_price", "discount_amount", "actual_amount", "created_at")})
    c = spark.createDataFrame([("c1", "A", "gold")], "customer_id string, customer_name string, member_level string")
    p = spark.createDataFrame([("p1", "P", "K")], "product_id string, product_name string, category_name string")
    got = sorted((r.order_id, str(r.order_detail_id), str(r.customer_name)) for r in wide.dwd_order_driven(o, d, c, p).collect())
    assert got == [("o1", "d1", "A"), ("o2", "None", "None")]
    assert len(wide.dwd_order_driven(o, d, c, p).columns) == 24


def test_wide_table_has_38_business_columns():
    parts = wide.DETAIL_PART + wide.ORDER_PART + wide.CUSTOMER_PART + wide.PRODUCT_PART
    assert len(parts) == 38


def test_money_precision_of_large_sums(spark):
    df = spark.range(1000).select(F.lit(D("9999999999999999.99")).cast("decimal(18,2)").alias("payable_amount"))
    total = df.agg(F.sum("payable_amount")).first()[0]
    assert total == D("9999999999999999.99") * 1000
