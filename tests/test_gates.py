"""Gates, exact decimals, unplaced rows, sessions, plans of the wide joins."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from martloom.functions.columns import half_up
from martloom.operators import gates, quality, wide
from martloom.plans import warehouse
from martloom.plans.store import LayerStore
from martloom.session import job_session, scratch_path, scratch_step, stage
from martloom.sources import partitions
from martloom.sources.retail import RetailTables


class Twice(RetailTables):
    """Every second customer and product is listed twice."""

    def customer(self):
        c = super().customer()
        return c.unionByName(c.filter("customer_id % 2 = 0"))

    def product(self):
        p = super().product()
        return p.unionByName(p.filter("product_id % 2 = 0"))


@pytest.mark.parametrize("build", [warehouse.detail_warehouse, warehouse.order_warehouse])
def test_repeated_members_stop_both_warehouses(spark, folder, tmp_path, build):
    store = LayerStore(spark, str(tmp_path))
    with pytest.raises(ValueError, match="customer_key_repeated.*product_key_repeated"):
        build(Twice(spark, folder), store)
    assert not (tmp_path / "dwd").exists()


def test_each_gate_counts_its_rows(spark):
    order = spark.createDataFrame([("o1", "c1"), ("o1", "c1"), (" ", "c1"), ("o2", "c9"), ("o3", None)], "order_id string, customer_id string")
    detail = spark.createDataFrame([("d1", "o1", "p1"), (None, "o2", "p1"), ("d2", "o7", "p8"), ("d2", "o3", "p1")],
                                   "order_detail_id string, order_id string, product_id string")
    customer = spark.createDataFrame([("c1",), ("c1",), ("c1",)], "customer_id string")
    product = spark.createDataFrame([("p1",), ("",)], "product_id string")
    found = gates.layer_gates(order, detail, customer, product)
    assert {r.gate: r.errors for r in found.collect()} == {
        "order_key_blank": 1, "order_key_repeated": 1, "detail_key_blank": 1, "detail_key_repeated": 1,
        "customer_key_blank": 0, "customer_key_repeated": 2, "product_key_blank": 1, "product_key_repeated": 0,
        "order_without_customer": 2, "detail_without_order": 1, "detail_without_product": 1, "order_without_detail": 1,
    }
    for gate, errors in {r.gate: r.errors for r in found.collect()}.items():
        one = found.where(F.col("gate") == gate)
        if errors:
            with pytest.raises(ValueError, match=f"{gate}.*{errors}"):
                gates.require_gates(one)
        gates.require_gates(one, allowed=(gate,))
    with pytest.raises(ValueError, match="wide has 5 rows, its source 4"):
        gates.require_same_rows(detail, order, "wide")


def test_no_decimals_are_cut(spark):
    df = spark.createDataFrame([("0.004",), ("0.006",), ("1.2345",), ("2.7189",)], "v string").select(F.col("v").cast("decimal(10,4)"))
    r = quality.numeric_summary(df, ["v"]).first()
    assert [str(x) for x in (r.min, r.max, r.mean, r.p25)] == ["0.0040", "2.7189", "0.9909", "0.005500"]
    one = df.limit(1)
    with pytest.raises(PySparkException, match="half_up"):
        one.select(half_up(F.col("v"), F.lit(1), 2)).collect()
    assert str(one.select(half_up(F.lit(1).cast("decimal(5,4)"), F.lit(3), 4, 4).alias("x")).first().x) == "0.3333"


def test_unplaced_rows_are_counted(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "2025-01-02 00:00:00"), ("c", None)], "order_id string, t string").select(
        "order_id", F.col("t").cast("timestamp_ntz").alias("order_time"))
    got = {r.order_month: r.row_count for r in partitions.month_partition_write(df, str(tmp_path / "m")).collect()}
    assert got == {None: 2, "2025-01": 1}
    none = partitions.month_partition_write(df.where("order_time is null"), str(tmp_path / "none"))
    assert [tuple(r) for r in none.collect()] == [(None, 2)]


def test_job_session_keeps_what_it_was_given(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    master = spark.sparkContext.master
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        session = job_session()
        assert session.conf.get("spark.sql.shuffle.partitions") == "17" and session.sparkContext.master == master
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_earlier_steps_are_deleted(spark):
    paths = []
    for number in (1, 2):
        with scratch_step(spark, number):
            kept = stage(spark.range(5), "numbers")
            paths.append(kept.inputFiles()[0])
    with pytest.raises(PySparkException):
        spark.read.parquet(paths[0]).count()
    assert kept.count() == 5 and "/shared/" in scratch_path(spark, "x")


def test_details_are_dealt_for_two_joins_at_most(spark, folder):
    t = RetailTables(spark, folder)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for plan in (
            wide.dwd_wide(t.detail(), t.order(), t.customer(), t.product()),
            wide.dwd_order_driven(t.order(), t.detail(), t.customer(), t.product()),
        ):
            text = plan._jdf.queryExecution().optimizedPlan().toString()
            # From the top: product, then order with detail; the customer join lies on the order side.
            joins = [line for line in text.splitlines() if "Join LeftOuter" in line]
            assert "product_id" in joins[0] and "order_id" in joins[1] and "customer_id" in joins[2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
