"""Both warehouses end to end from CSV, through every gate."""

import pytest
from pyspark.sql import functions as F

from checks.text_tables import _text
from martloom.operators import gates, reconcile, sales
from martloom.plans import month_load, warehouse
from martloom.plans.store import LayerStore
from martloom.sources import schemas, sinks
from martloom.sources.retail import RetailTables
from martloom.sources.retail_csv import CleanedCsvTables, CsvTables


@pytest.fixture(scope="module")
def csv_folder(spark, folder, tmp_path_factory):
    """Coherent CSV tables derived from the test tables: orders have details,
    their amount is the sum of them, statuses carry the warehouse's own names."""
    base = tmp_path_factory.mktemp("csv")
    t = RetailTables(spark, folder)
    sums = t.detail().groupBy("order_id").agg(F.sum("actual_amount").cast("decimal(18,2)").alias("s"))
    status = F.col("order_status")
    order = (
        t.order(with_area=True)
        .join(sums, "order_id")
        .withColumns(
            {
                "order_amount": F.col("s"),
                "payable_amount": F.col("s") - F.col("coupon_amount") + F.col("freight_amount"),
                "order_status": F.when(status == "O", "已支付").when(status == "F", "已完成").otherwise("待支付"),
                "shop_id": F.lit("S00001"),
            }
        )
    )
    for name, df in {"order": order, "order_detail": t.detail(), "customer": t.customer(), "product": t.product()}.items():
        sinks.csv_sink(_text(df, schemas.TABLES[name]), f"{base}/{name}.csv")
    return str(base)


def test_detail_warehouse_passes_29_checks(spark, csv_folder, tmp_path):
    result = warehouse.run(CsvTables(spark, csv_folder), str(tmp_path), "detail")
    rows = result.collect()
    assert len(rows) == 29 and all(r.passed for r in rows)
    store = LayerStore(spark, str(tmp_path))
    assert len(store.read("dwd_order_detail").columns) == 41
    parity = reconcile.layer_row_parity(
        {n: store.read(n) for n in {x for _, a, b in reconcile.PARITY_PAIRS for x in (a, b)}}
    ).collect()
    assert [r.passed for r in parity[:3]] == [True, True, True]
    months = str(tmp_path / "months")
    assert month_load.main([store.path("dwd_order_detail"), months, "1997-05"]) == 0
    assert month_load.main([store.path("dwd_order_detail"), months, "1997-5"]) == 2
    assert month_load.main([]) == 2


def test_order_warehouse_passes_12_checks(spark, csv_folder, tmp_path):
    result = warehouse.run(CsvTables(spark, csv_folder), str(tmp_path), "order")
    rows = result.collect()
    assert len(rows) == 12 and all(r.passed for r in rows)
    store = LayerStore(spark, str(tmp_path))
    assert store.read("quality_report").count() == 6
    assert store.read("quality_score").first().level in {"A级", "B级", "C级", "D级"}


def test_failed_checks_stop_the_run_with_names(spark):
    df = spark.createDataFrame([("good", True), ("bad one", False)], "check_name string, passed boolean")
    with pytest.raises(ValueError, match="bad one"):
        reconcile.require_all_passed(df)


def test_unreadable_values_stop_the_ingest(spark, csv_folder, tmp_path):
    raw = CsvTables(spark, csv_folder).raw("product")
    sinks.csv_sink(raw.withColumn("unit_price", F.lit("cheap")), str(tmp_path / "product.csv"))
    with pytest.raises(ValueError, match="unit_price"):
        CsvTables(spark, str(tmp_path)).product()
    cleaned = CsvTables(spark, str(tmp_path)).cleaned("product")
    assert cleaned.filter("unit_price is not null").count() == 0


def test_dirty_files_pass_through_the_clean_step(spark, csv_folder, tmp_path):
    """A bad amount, duplicate rows and a padded status; strict typing stops, the clean step goes on to 12 checks."""
    for name in schemas.TABLES:
        raw = CsvTables(spark, csv_folder).raw(name)
        if name == "order":
            first = F.col("order_id") == raw.agg(F.min("order_id")).first()[0]
            raw = raw.withColumns({
                "coupon_amount": F.when(first, F.lit("many")).otherwise(F.col("coupon_amount")),
                "order_status": F.concat(F.lit("  "), "order_status", F.lit(" ")),
            })
            raw = raw.unionByName(raw.limit(40))
        sinks.csv_sink(raw, str(tmp_path / f"{name}.csv"))
    with pytest.raises(ValueError, match="coupon_amount"):
        CsvTables(spark, str(tmp_path)).order()
    base = str(tmp_path / "out")
    result = warehouse.run(CleanedCsvTables(spark, str(tmp_path)), base, "order").collect()
    assert len(result) == 12 and all(r.passed for r in result)
    store = LayerStore(spark, base)
    order = store.read("ods_order")
    assert order.count() == CsvTables(spark, csv_folder).raw("order").count()
    assert order.where("order_status like ' %'").count() == 0 and order.where("coupon_amount = 0").count() > 0
    for name in ("fact_order", "fact_order_detail", "dim_customer", "dim_product", "dim_date", "ads_user_rfm_segment_summary"):
        assert store.read(name).count() > 0


def test_disagreeing_details_stop_the_run(spark):
    rows = [("o1", "2025-01-01"), ("o1", "2025-01-02"), ("o2", "2025-01-01")]
    grain = sales.order_grain(spark.createDataFrame(rows, "order_id string, order_time string"), ("order_id", "order_time"))
    with pytest.raises(ValueError, match="1 rows beyond one per order_id"):
        gates.require_unique_key(grain, "order_id", "grain")
    assert "SortAggregate" not in grain._jdf.queryExecution().executedPlan().toString()


def test_unknown_kind(spark, csv_folder, tmp_path):
    with pytest.raises(ValueError, match="kind"):
        warehouse.run(CsvTables(spark, csv_folder), str(tmp_path), "other")
