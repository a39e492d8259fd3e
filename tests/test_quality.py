"""Rules on hand-made rows; injected faults are found exactly."""

from datetime import datetime
from decimal import Decimal as D

from pyspark.sql import functions as F

from martloom.operators import clean, quality, rank
from martloom.operators.quality import RuleSet
from martloom.session import stage
from martloom.sources import schemas

T1, T2 = datetime(2025, 1, 1, 10), datetime(2025, 1, 2, 10)
ORDER = "order_id string, customer_id string, order_time timestamp_ntz, order_status string, order_amount decimal(18,2), coupon_amount decimal(18,2), freight_amount decimal(18,2), payable_amount decimal(18,2)"
DETAIL = "order_detail_id string, order_id string, product_id string, quantity int, unit_price decimal(18,2), discount_amount decimal(18,2), actual_amount decimal(18,2), created_at timestamp_ntz"


def order_row(i, **changes):
    row = dict(order_id=i, customer_id="c1", order_time=T1, order_status="已支付", order_amount=D(20), coupon_amount=D(5), freight_amount=D(2), payable_amount=D(17))
    return tuple((row | changes).values())


def detail_row(i, **changes):
    row = dict(order_detail_id=i, order_id="o1", product_id="p1", quantity=2, unit_price=D(10), discount_amount=D(0), actual_amount=D(20), created_at=T2)
    return tuple((row | changes).values())


def masters(spark, customers=(("c1", "A"),), products=(("p1", "K"),)):
    return (
        spark.createDataFrame(customers, "customer_id string, customer_name string"),
        spark.createDataFrame(products, "product_id string, category_name string"),
    )


def test_manifest_lists_exactly_the_injected_faults(spark):
    orders = spark.createDataFrame(
        [
            order_row("o1"),
            order_row("o2", customer_id="C_MISSING_000001"),
            order_row("o3", payable_amount=D(0)),
            order_row("o4", order_status="未知状态"),
            order_row("o5"),
            order_row("o5"),
            order_row("o5"),
        ],
        ORDER,
    )
    details = spark.createDataFrame(
        [
            detail_row("d1"),
            detail_row("d2", quantity=999, actual_amount=D(9990)),
            detail_row("d3", actual_amount=D(25)),
            detail_row("d4", product_id="P_MISSING_000001"),
            detail_row("d5", created_at=datetime(2024, 12, 1)),
            detail_row("d6"),
            detail_row("d6"),
        ],
        DETAIL,
    )
    customers, products = masters(spark, (("c1", "A"), ("c2", None)), (("p1", "K"), ("p2", None)))
    got = sorted(
        (r.dataset, r.row_id, r.rule_code, r.field, r.occurrences)
        for r in quality.anomaly_manifest(orders, details, customers, products).collect()
    )
    assert got == sorted(
        [
            ("order", "o2", "CUSTOMER_FK", "customer_id", 1),
            ("order", "o3", "ORDER_AMOUNT_FORMULA", "payable_amount", 1),
            ("order", "o4", "ORDER_STATUS_ENUM", "order_status", 1),
            ("order", "o5", "DUPLICATE_ROW", "all", 2),
            ("order_detail", "d2", "QUANTITY_RANGE", "quantity", 1),
            ("order_detail", "d3", "DETAIL_AMOUNT_FORMULA", "actual_amount", 1),
            ("order_detail", "d4", "PRODUCT_FK", "product_id", 1),
            ("order_detail", "d5", "DETAIL_TIME", "created_at", 1),
            ("order_detail", "d6", "DUPLICATE_ROW", "all", 1),
            ("customer", "c2", "CUSTOMER_NAME_NULL", "customer_name", 1),
            ("product", "p2", "CATEGORY_NULL", "category_name", 1),
        ]
    )


def test_integrity_suite_is_silent_on_clean_rows(spark):
    orders = spark.createDataFrame([order_row("o1")], ORDER)
    details = spark.createDataFrame([detail_row("d1")], DETAIL)
    got = {r.rule: r.errors for r in quality.integrity_suite(orders, details, *masters(spark)).collect()}
    assert len(got) == 12 and set(got.values()) == {0}


def test_key_repeated_with_other_content_is_not_a_duplicate_row(spark):
    orders = spark.createDataFrame([order_row("o1"), order_row("o1", coupon_amount=D(6), payable_amount=D(16))], ORDER)
    details = spark.createDataFrame([detail_row("d1")], DETAIL)
    assert quality.anomaly_manifest(orders, details, *masters(spark)).count() == 0
    assert tuple(quality.pk_duplicates(orders, "order_id").first()) == (1, 1)


def test_rule_duplicate_treats_null_keys_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4), ("b", 5)], "k string, v int")
    assert sorted(r.v for r in quality.rule_duplicate(df, ["k"]).collect()) == [1, 2, 4, 5]
    assert sorted(r.v for r in quality.rule_duplicate(df, ["k", "v"]).collect()) == []


def rules():
    return RuleSet(keys=["order_id"], declared={"order_id": "string", "payable_amount": "number", "gone": "string"}, minimum_rows=1)


def test_rule_suite_counts_and_score(spark):
    df = spark.createDataFrame(
        [
            order_row("o1"),
            order_row("o1"),
            order_row("o2", customer_id=None),
            order_row("o3", payable_amount=D(-1)),
            order_row("o4", payable_amount=None),
        ],
        ORDER,
    )
    report = quality.rule_suite(df, rules())
    got = {r.rule_name: (r.status, r.error_count, r.severity) for r in report.collect()}
    assert got == {
        "NullRule": ("FAILED", 2, "HIGH"),
        "DuplicateRule": ("FAILED", 2, "MEDIUM"),
        "TypeRule": ("FAILED", 1, "HIGH"),
        "BusinessRule": ("FAILED", 2, "HIGH"),
        "AmountRule": ("FAILED", 1, "MEDIUM"),
        "CountRule": ("SUCCESS", 0, "LOW"),
    }
    score = quality.quality_score(report).first()
    assert (score.total_score, score.level) == (D("99.20"), "A级")
    failed = sorted((r.order_id, r.rule_name) for r in quality.error_rows(df, rules()).collect())
    assert failed == [
        ("o1", "DuplicateRule"),
        ("o1", "DuplicateRule"),
        ("o2", "NullRule"),
        ("o3", "AmountRule"),
        ("o3", "BusinessRule"),
        ("o4", "BusinessRule"),
        ("o4", "NullRule"),
    ]


def test_rule_suite_on_no_rows(spark):
    df = spark.createDataFrame([], ORDER)
    got = {r.rule_name: r.error_count for r in quality.rule_suite(df, rules()).collect()}
    assert got["CountRule"] == 1 and got["NullRule"] == got["DuplicateRule"] == got["BusinessRule"] == 0


def test_score_never_goes_below_zero_weight(spark):
    report = spark.createDataFrame(
        [("NullRule", "FAILED", 100000, "HIGH", ""), ("DuplicateRule", "FAILED", 50, "MEDIUM", "")],
        "rule_name string, status string, error_count bigint, severity string, message string",
    )
    score = quality.quality_score(report).first()
    assert (score.total_score, score.level) == (D("65.00"), "C级")


def test_range_and_enum_treat_null_as_asked(spark):
    df = spark.createDataFrame([(None,), (0,), (121,), (50,)], "age int")
    assert quality.range_check(df, "age", 0, 120).count() == 2
    assert quality.range_check(df, "age", 0, 120, nulls_outside=False).count() == 1
    assert quality.enum_check(df, "age", [0, 50]).count() == 2


def test_amount_rule_zero(spark):
    df = spark.createDataFrame([(D(0),), (D(-1),), (D(1),), (None,)], "payable_amount decimal(18,2)")
    assert quality.rule_amount(df).count() == 1
    assert quality.rule_amount(df, or_zero=True).count() == 2


def test_formula_tolerance(spark):
    df = spark.createDataFrame([order_row("o1", payable_amount=D("17.01")), order_row("o2", payable_amount=D("17.02")), order_row("o3", payable_amount=None)], ORDER)
    assert quality.rule_business_formula(df).count() == 3
    assert quality.rule_business_formula(df, "0.01").count() == 2
    assert quality.rule_business_formula(df, "0.01", nulls_fail=False).count() == 1


def test_key_blank_check(spark):
    df = spark.createDataFrame([(None,), (" ",), ("a",)], "k string")
    assert quality.key_blank_check(df, ["k"]).first().blank_rows == 2


def test_orphans_keep_null_keys_and_copies(spark):
    child = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("b", 4)], "k string, v int")
    parent = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    for many in (False, True):
        assert sorted(r.v for r in quality.orphans(child, parent, "k", many).collect()) == [2, 3, 4]


def test_numeric_summary_small(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (4,), (None,)], "q int")
    r = quality.numeric_summary(df, ["q"]).first()
    assert (r.row_count, r.mean, r.p25, r.p50, r.p75) == (4, D("2.75"), D("1.7500"), D("3.0000"), D("4.0000"))


def test_numeric_summary_keeps_small_and_large_doubles(spark):
    df = spark.createDataFrame([(1e-7, 1e24, 1), (3e-7, 1e24, None), (5e-7, -1e300, None), (None, None, None)], "t double, h double, i int")
    t, h, i = quality.numeric_summary(df, ["t", "h", "i"]).collect()
    assert (t.row_count, t.p50, t.min, t.max) == (3, 3e-7, 1e-7, 5e-7)
    assert (h.min, h.p50, h.max) == (-1e300, 1e24, 1e24) and (i.row_count, i.mean, i.p99) == (1, 1.0, 1.0)
    nothing = quality.numeric_summary(df.where("false"), ["t", "i"]).collect()
    assert [(r.column_name, r.row_count, r.mean, r.p50) for r in nothing] == [("t", 0, None, None), ("i", 0, None, None)]


def test_numeric_summary_ranks_all_columns_in_one_shuffle(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "n")
    spark.range(100).select("id", (F.col("id") % 7).alias("a"), (F.col("id") * 0.5).alias("b")).write.parquet(path)
    plans = []

    def spied(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(rank, "stage", spied)
    quality.numeric_summary(spark.read.parquet(path), ["id", "a", "b"])
    initial = plans[0].split("Initial Plan")[-1]
    assert len(plans) == 1 and initial.count("FileScan") == 1 and initial.count("rangepartitioning") == 1


def test_reconcile_flags(spark):
    df = spark.createDataFrame([order_row("o1")], ORDER).withColumn("actual_amount", F.lit(D("19.50")))
    r = quality.header_detail_reconcile(df).first()
    assert (r.order_amount_match, r.payable_match, r.order_amount_difference) == (False, True, D("0.50"))


# ---- typing and cleaning -------------------------------------------------


def text_details(spark, rows):
    return spark.createDataFrame(rows, schemas.text_schema(schemas.ORDER_DETAIL))


def test_uncastable_counts_ignore_blanks(spark):
    df = text_details(
        spark,
        [
            ("d1", "o1", "p1", "x", "1.5", "0", "1.5", "2025-01-01 00:00:00"),
            ("d2", "o1", "p1", " ", "abc", "", None, "2025-02-30 00:00:00"),
            ("d3", "o1", "p1", "3", "1", "1", "1", "2025/01/01"),
        ],
    )
    got = {r.column_name: r.bad for r in clean.uncastable_counts(df, schemas.ORDER_DETAIL).collect()}
    assert got == {"quantity": 1, "unit_price": 1, "discount_amount": 0, "actual_amount": 0, "created_at": 2}
    typed = {r.order_detail_id: r for r in clean.ods_typed(df, schemas.ORDER_DETAIL).collect()}
    assert typed["d1"].quantity is None and typed["d1"].created_at == datetime(2025, 1, 1)
    assert typed["d3"].quantity == 3 and typed["d3"].created_at is None


def test_clean_table_edges(spark):
    row = ("d1", " o1 ", " p1", "2", "1.234", "0", "bad", "2025-01-01 00:00:00")
    done = clean.clean_table(text_details(spark, [row, row, ("d2", None, "p2", "1", "1", "1", None, "later")]))
    got = {r.order_detail_id: r for r in done.collect()}
    assert len(got) == done.count() == 2
    assert got["d1"].order_id == "o1" and got["d1"].product_id == "p1"
    assert got["d1"].actual_amount == 0 and got["d1"].unit_price == D("1.23")
    assert got["d2"].order_id is None and got["d2"].created_at is None


def test_removed_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("a", 2), (None, 1), (None, 1)], "k string, v int")
    assert clean.drop_exact_duplicates(df).count() == 3
    assert sorted((str(r.k), r.removed_copies) for r in clean.removed_duplicates(df).collect()) == [("None", 1), ("a", 2)]
