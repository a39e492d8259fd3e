"""Scans per job, hot keys by sketch, conflicts, checks at the table, publishing of tables."""

import pytest
from pyspark.sql import functions as F

from checks.registry import Tables
from martloom.operators import gates, quality, reconcile, sales, skew, star
from martloom.plans import layer_audit, layer_checks, warehouse
from martloom.plans.store import LayerStore
from martloom.sources import layout, schemas, sinks
from martloom.sources.retail import RetailTables
from martloom.sources.retail_csv import CsvTables


def initial(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def scans(plans: list[str], column: str) -> int:
    return sum(line.count("FileScan") for p in plans for line in p.splitlines() if "FileScan" in line and column in line)


@pytest.fixture
def staged_plans(monkeypatch):
    plans = []

    def spy(module):
        real = module.stage

        def spied(df, name):
            plans.append(initial(df))
            return real(df, name)

        monkeypatch.setattr(module, "stage", spied)
        return plans

    return spy


def test_integrity_suite_reads_details_twice(spark, folder, staged_plans):
    plans = staged_plans(quality)
    t = RetailTables(spark, folder)
    out = quality.integrity_suite(t.order(), t.detail(), t.customer(), t.product())
    plans.append(initial(out))
    # Subqueries over written tables aside, every scan of details reads l_orderkey.
    assert scans(plans, "l_orderkey") == 2
    assert sum(p.count("Exchange hash") for p in plans) <= 7


def test_integrity_suite_counts_lost_orders_with_the_sums_per_order(spark, folder, monkeypatch):
    """References to orders are not listed beside the details' own keys a second time."""
    staged, real = [], quality.stage
    monkeypatch.setattr(quality, "stage", lambda df, name: staged.extend(df.columns) or real(df, name))
    t = RetailTables(spark, folder)
    detail = t.detail()
    kind = detail.schema["order_id"].dataType
    unknown = detail.limit(3).withColumn("order_id", F.lit(-1).cast(kind))
    blank = detail.limit(2).withColumn("order_id", F.lit(None).cast(kind))
    out = quality.integrity_suite(t.order(), detail.unionByName(unknown).unionByName(blank), t.customer(), t.product())
    assert "lost" in staged
    assert {r.rule: r.errors for r in out.collect()}["detail_order"] == 5


def test_manifest_reads_details_twice(spark, folder):
    t = RetailTables(spark, folder)
    plan = initial(quality.anomaly_manifest(t.order(), t.detail(), t.customer(), t.product()))
    assert scans([plan], "l_orderkey") == 2


def test_skew_audit_takes_one_exchange_of_keys(spark, tmp_path):
    path = str(tmp_path / "k")
    spark.range(1000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 2 == 0, "x").alias("b"), F.col("id").alias("c")).write.parquet(path)
    out = skew.key_skew_audit(spark.read.parquet(path), ["a", "b", "c"])
    plan = initial(out)
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning(column_name") == 2  # keys, then a row per column
    got = {r.column_name: (r.null_count, r.key_count, r.max_rows) for r in out.collect()}
    assert got == {"a": (0, 7, 143), "b": (500, 1, 500), "c": (0, 1000, 1)}


@pytest.mark.parametrize("limit", [4, 64, 1000])
def test_salted_equals_plain_with_many_near_hot_keys(spark, tmp_path, limit):
    path, i = str(tmp_path / "s"), F.col("id")
    key = F.when(i % 5 == 0, None).when(i % 2 == 0, (i % 140).cast("string")).otherwise(i.cast("string"))
    spark.range(20_000).select("id", key.alias("k"), (i % 13).alias("v")).write.parquet(path)
    df = spark.read.parquet(path)
    plain = df.groupBy("k").agg(F.count(F.lit(1)).alias("row_count"), F.sum("v").alias("total_amount"))
    got = skew.salted_aggregate(df, "k", "v", "id", limit=limit)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert scans([initial(got)], "k:string") == 2
    hot = {r.k for r in skew.hot_keys(df, "k", limit).collect()}
    sure = {r.k for r in plain.where(F.col("row_count") * limit >= 20_000).collect()}
    assert sure <= hot and len(hot) <= limit


def test_conflicting_members_are_reported(spark):
    rows = [("c1", "A", "x"), ("c1", "A", "x"), ("c2", "B", "x"), ("c2", "A", "x"), ("c2", None, "x"), ("c3", None, None)]
    df = spark.createDataFrame(rows, "customer_id string, customer_name string, member_level string")
    assert [tuple(r) for r in star.customer_conflicts(df).collect()] == [("c2", 3)]
    dim = star.dim_customer(df)
    assert sorted(map(tuple, dim.collect())) == [("c1", "A", "x", 1), ("c2", None, "x", 3), ("c3", None, None, 1)]
    assert "SortAggregate" not in initial(dim)


def test_headers_are_hash_aggregates(spark, folder):
    t = Tables(spark, folder)
    rows = t.clean.detail().select("order_id", "actual_amount").join(t.clean.order(), "order_id", "left")
    assert "SortAggregate" not in initial(quality.header_detail_reconcile(rows))


# ---- ingest --------------------------------------------------------------


def test_csv_is_parsed_once(spark, folder, tmp_path, monkeypatch, staged_plans):
    from checks.text_tables import _text
    from martloom.operators import clean

    sinks.csv_sink(_text(RetailTables(spark, folder).product(), schemas.TABLES["product"]), str(tmp_path / "product.csv"))
    plans = staged_plans(clean)
    typed = CsvTables(spark, str(tmp_path)).product()
    assert [p.count("FileScan csv") for p in plans] == [1]
    assert "FileScan csv" not in initial(typed) and typed.count() > 0


# ---- tables are replaced after their checks ------------------------------


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def failing(spark):
    """A good source and a bad table for every check that a plan hangs on a table, with the check that must name it."""
    orders = frame(spark, [("o1", 5), ("o2", 7)], "order_id string, payable_amount int").withColumn("payable_amount", F.col("payable_amount").cast("decimal(18,2)"))
    users = frame(spark, [("c1", 2, 11)], "customer_id string, order_count bigint, total_amount int")
    areas = frame(spark, [("a", 1, 12)], "area string, order_count bigint, sales_amount int")
    details = frame(spark, [(2, 12)], "quantity int, actual_amount int")
    products = frame(spark, [("p1", 1, 2, 12), ("p1", 0, 0, 0)], "product_id string, sales_detail_count bigint, sales_count bigint, sales_amount int")
    trend = frame(spark, [("2025-01", 1, 12, 1, 11)], "year_month string, order_count bigint, sales_amount int, cumulative_order_count bigint, cumulative_sales_amount int")
    base = frame(spark, [("c1", 1, 2, 11), ("c1", 1, 2, 0)], "customer_id string, recency_days int, frequency bigint, monetary int").withColumn(
        "monetary", F.col("monetary").cast("decimal(18,2)")
    )
    scored = base.select("*", *[F.lit(9).alias(c) for c in ("r_score", "f_score", "m_score")], F.lit(27).alias("rfm_total_score"), F.lit("x").alias("user_segment"))
    ranked = frame(spark, [("p1", 2, 12, 2)], "product_id string, sales_count bigint, sales_amount int, sales_amount_rank bigint").withColumns(
        {"sales_amount": F.col("sales_amount").cast("decimal(18,2)"), "cumulative_sales_amount": F.lit(12).cast("decimal(38,2)"),
         "cumulative_sales_amount_rate": F.lit(1).cast("decimal(18,8)"), "sales_amount_rate": F.lit(1).cast("decimal(18,8)"), "abc_level": F.lit("?")}
    )
    wide = frame(spark, [("o1", None)], "order_id string, order_detail_id string")
    off = frame(spark, [("o1", 5, 0, 0, 5, 4)], "order_id string, order_amount int, coupon_amount int, freight_amount int, payable_amount int, actual_amount int")
    off = off.select("order_id", *[F.col(c).cast("decimal(18,2)").alias(c) for c in off.columns[1:]])
    one_user = frame(spark, [("c1", 2, 11)], "customer_id string, order_count bigint, total_amount int")
    return {
        "user_amount": (users, lambda f: reconcile.user_sales_checks(orders, f)),
        "product_repeated": (products, lambda f: reconcile.product_sales_checks(details, f)),
        "area_orders": (areas, lambda f: reconcile.area_sales_checks(orders, f)),
        "daily_orders": (areas, lambda f: reconcile.daily_sales_checks(orders, f)),
        "last_running_amount": (trend, lambda f: reconcile.monthly_checks(areas, f)),
        "rfm_users, duplicate_users": (base, lambda f: layer_checks.rfm_base(one_user, f)),
        "invalid_scores": (scored, lambda f: layer_checks.rfm_segments(base, f)),
        "abc_first_rank": (ranked, lambda f: layer_checks.product_classes(ranked, f)),
        "wide_orders, wide_details": (wide, lambda f: layer_checks.wide_rows(orders, details, f)),
        "x_rows": (orders.limit(1), lambda f: layer_checks.same_rows(orders, f, "x")),
        "x_repeated": (products, lambda f: layer_checks.unique_key(f, "product_id", "x")),
        "product_quantity": (products.limit(1).withColumn("sales_count", F.lit(1)), lambda f: layer_checks.basic_products(details, f)),
        "header_detail_errors": (off, layer_checks.amounts),
        "conflicting": (users, lambda f: warehouse.quality_rows(f, "conflicting")),
    }


def test_a_failed_check_leaves_the_earlier_table(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path))
    store.write("dws_x", spark.range(3))
    for names, (bad, check) in failing(spark).items():
        with pytest.raises(ValueError, match=names):
            store.write("dws_x", bad, check)
        assert store.read("dws_x").count() == 3, names
    store.write("dws_x", spark.range(4), lambda f: layer_checks.same_rows(spark.range(4), f, "x"))
    # A table may be rebuilt from itself: it is written aside first.
    assert store.write("dws_x", store.read("dws_x").where("id > 0")).count() == 3
    assert sorted(store.tables()) == ["dws_x"] and layout.table_files(spark, store.path("dws_x")).count() > 0


def test_table_moved_out_and_not_replaced_is_put_back(spark, tmp_path, monkeypatch):
    from martloom.sources.publish import Folder

    store = LayerStore(spark, str(tmp_path))
    store.write("dws_x", spark.range(3))
    move, moves = Folder.move, []

    def breaks(self, name, to):
        if moves:
            raise KeyboardInterrupt
        moves.append(name)
        move(self, name, to)

    monkeypatch.setattr(Folder, "move", breaks)
    with pytest.raises(KeyboardInterrupt):
        store.write("dws_x", spark.range(9))
    monkeypatch.setattr(Folder, "move", move)
    assert store.repair() == ["dws_x"] and store.read("dws_x").count() == 3 and store.repair() == []


def test_plans_check_their_tables(spark, folder, tmp_path, monkeypatch):
    checked = {"detail": set(), "order": set()}
    publish = LayerStore._publish

    def spied(self, table, df, sink, check):
        if check:
            checked[kind].add(table)
        return publish(self, table, df, sink, check)

    monkeypatch.setattr(LayerStore, "_publish", spied)
    shared = {"dwd_order_detail", "dwd_valid_order", "dws_user_sales", "dws_product_sales", "ads_sales_summary", "ads_user_rfm_base",
              "fact_order", "dim_customer", "dim_product"}
    for kind, build in (("detail", warehouse.detail_warehouse), ("order", warehouse.order_warehouse)):
        build(RetailTables(spark, folder), LayerStore(spark, str(tmp_path / kind)))
    assert checked["order"] == shared
    assert checked["detail"] == shared | {"dws_area_sales", "ads_monthly_sales_trend", "ads_user_rfm_segment", "ads_product_abc"}
    with pytest.raises(ValueError, match="header_detail_errors"):
        warehouse.detail_warehouse(RetailTables(spark, folder), LayerStore(spark, str(tmp_path / "strict")), strict_amounts=True)
    store = LayerStore(spark, str(tmp_path / "order"))
    rows = {r.table_name: r for r in layer_audit.files(store).collect()}
    assert rows["dwd_order_detail"].present and rows["dwd_order_detail"].row_count == store.read("dwd_order_detail").count()
    assert {r.table_name for r in layer_audit.skew(store).collect()} == {"dwd_order_detail", "fact_order"}


def test_layout_counts_partitions_and_missing_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") % 5).alias("p"), (F.col("id") % 2).alias("q")).repartition(1).write.partitionBy("p", "q").parquet(path)
    got = {r.table_name: r for r in layout.file_layout_audit(spark, {"t": path, "none": str(tmp_path / "none")}).collect()}
    assert (got["t"].present, got["t"].files, got["t"].partitions, got["t"].row_count, got["t"].largest_file_rows) == (True, 10, 10, 100, 10)
    assert (got["none"].present, got["none"].files, got["none"].small_files, got["none"].broadcastable) == (False, 0, False, False)
    assert "ReadSchema: struct<>" in initial(layout.footers(spark, path))


def test_small_side_is_broadcast_after_a_size_check(spark, folder):
    from martloom.operators import wide

    t = RetailTables(spark, folder)
    small, large = [wide.join_strategy_equivalence(t.detail(), t.product(), n) for n in (10 << 20, 10)]
    assert initial(small).count("BroadcastHashJoin") == 1 and initial(small).count("SortMergeJoin") == 1
    assert initial(large).count("ShuffledHashJoin") == 1 and "BroadcastHashJoin" not in initial(large)
    assert {r.strategy: (r.joined_rows, r.unmatched_rows) for r in large.collect()} == dict.fromkeys(("merge", "shuffle_hash"), (t.detail().count(), 0))


@pytest.mark.parametrize("one_hash", [False, True])
def test_gates_deal_hashes_of_detail_ids(spark, monkeypatch, staged_plans, one_hash):
    """Ids are counted by hash; ids that only share a hash are not repeated ones."""
    plans = staged_plans(gates)
    if one_hash:
        monkeypatch.setattr(gates.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    detail = spark.createDataFrame([(k,) for k in ("a", "b", "b", "b", "c", "", " ", None)], "order_detail_id string")
    row = gates.long_key_errors(detail, "order_detail_id", "detail").first()
    assert (row.detail_key_blank, row.detail_key_repeated) == (3, 2)
    assert len(plans) == 1 and "Exchange hashpartitioning(hash#" in plans[0] and "Exchange hashpartitioning(order_detail_id" not in plans[0]
    none = gates.long_key_errors(detail.limit(0), "order_detail_id", "detail").first()
    assert (none.detail_key_blank, none.detail_key_repeated) == (0, 0)


def test_product_sales_of_gated_details_compare_no_ids(spark, folder):
    t = RetailTables(spark, folder)
    details = t.detail().join(t.order().select("order_id", "order_time"), "order_id")
    plain, gated = (sales.product_sales(details, t.product(), once) for once in (False, True))
    assert "order_detail_id" in "".join(x for x in initial(plain).splitlines() if "Exchange hash" in x or "keys=" in x)
    assert "order_detail_id" not in "".join(x for x in initial(gated).splitlines() if "Exchange hash" in x or "keys=" in x)
    assert sorted(map(str, plain.collect())) == sorted(map(str, gated.collect()))
