"""Both warehouses, layer by layer, each table written once and then read.

``detail_warehouse`` starts its wide table at the details and ends in 29
checks; ``order_warehouse`` starts at the orders, runs the rule report first
and ends in 12.
"""

from __future__ import annotations

import argparse
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.functions.columns import with_etl_columns
from martloom.operators import abc, gates, quality, reconcile, rfm, sales, star, wide
from martloom.plans import layer_checks
from martloom.plans.store import LayerStore
from martloom.session import job_session, scratch_scope, shuffles_dropped

GRAIN = (
    "order_id",
    "customer_id",
    "customer_name",
    "order_time",
    "payable_amount",
    "coupon_amount",
    "freight_amount",
    "receiver_province_code",
    "receiver_province_name",
)

# Orders without details are kept by the order-driven warehouse and seen by the checks of the other.
ALLOWED = ("order_without_detail",)


def typed_layer(source, store: LayerStore) -> dict[str, DataFrame]:
    tables = {
        "ods_order": source.order(with_area=True),
        "ods_order_detail": source.detail(),
        "ods_customer": source.customer(),
        "ods_product": source.product(),
    }
    return {name: store.write(name, with_etl_columns(df)) for name, df in tables.items()}


def gated(t: dict[str, DataFrame], store: LayerStore, allowed: tuple[str, ...]) -> None:
    """Stop before any joined layer if keys are blank or repeated, or partners are missing."""
    found = store.write_small(
        "quality_gates",
        gates.layer_gates(t["ods_order"], t["ods_order_detail"], t["ods_customer"], t["ods_product"]),
    )
    t["quality_gates"] = found
    gates.require_gates(found, allowed)


def _dropping_shuffles(build):
    """Each step writes a table that the later ones read, so what it has shuffled is not needed after it."""

    @wraps(build)
    def run(source, store: LayerStore, *args, **kwargs):
        with shuffles_dropped(store.spark):
            return build(source, store, *args, **kwargs)

    return run


@_dropping_shuffles
def detail_warehouse(
    source, store: LayerStore, allowed: tuple[str, ...] = ALLOWED, strict_amounts: bool = False
) -> dict[str, DataFrame]:
    """ODS, wide table, subject tables, metrics, segments, classes, star. Each table is checked where it is written."""
    t = typed_layer(source, store)
    gated(t, store, allowed)
    customer, product = t["ods_customer"], t["ods_product"]
    def wide_check(found: DataFrame) -> DataFrame:
        rows = layer_checks.same_rows(t["ods_order_detail"], found, "dwd_order_detail")
        return rows.unionByName(layer_checks.amounts(found)) if strict_amounts else rows

    d = store.write_parts(
        "dwd_order_detail", wide.dwd_wide_parts(t["ods_order_detail"], t["ods_order"], customer, product), wide_check
    )
    t["dwd_order_detail"] = d
    valid = sales.valid_sales(d, source.statuses)
    # Order grain feeds three tables, so it is a table of its own.
    grain = store.write(
        "dwd_valid_order", sales.order_grain(valid, GRAIN), lambda f: layer_checks.unique_key(f, "order_id", "dwd_valid_order")
    )
    t["dws_user_sales"] = store.write(
        "dws_user_sales", with_etl_columns(sales.user_sales(grain, customer)), lambda f: reconcile.user_sales_checks(grain, f)
    )
    # Each detail id is there once if its gates have held: no join adds a row (same_rows).
    once = not {"detail_key_blank", "detail_key_repeated"} & set(allowed)
    t["dws_product_sales"] = store.write(
        "dws_product_sales", with_etl_columns(sales.product_sales(valid, product, once)), lambda f: reconcile.product_sales_checks(valid, f)
    )
    t["dws_area_sales"] = store.write_small(
        "dws_area_sales", with_etl_columns(sales.area_sales(grain)), lambda f: reconcile.area_sales_checks(grain, f)
    )
    t["ads_sales_summary"] = store.write_small(
        "ads_sales_summary", with_etl_columns(sales.daily_sales(grain)), lambda f: reconcile.daily_sales_checks(grain, f)
    )
    trend = sales.monthly_trend(sales.monthly_base(t["ads_sales_summary"]))
    t["ads_monthly_sales_trend"] = store.write_small(
        "ads_monthly_sales_trend", with_etl_columns(trend), lambda f: reconcile.monthly_checks(t["ads_sales_summary"], f)
    )
    t["ads_user_rfm_base"] = store.write(
        "ads_user_rfm_base", rfm.rfm_base(t["dws_user_sales"]), lambda f: layer_checks.rfm_base(t["dws_user_sales"], f)
    )
    segments = rfm.segments(rfm.scores_by_ntile(t["ads_user_rfm_base"]))
    t["ads_user_rfm_segment"] = store.write(
        "ads_user_rfm_segment", with_etl_columns(segments), lambda f: layer_checks.rfm_segments(t["ads_user_rfm_base"], f)
    )
    t["ads_user_rfm_segment_summary"] = store.write_small(
        "ads_user_rfm_segment_summary", rfm.segment_summary(t["ads_user_rfm_segment"])
    )
    ranked = abc.product_ranking(t["dws_product_sales"].drop("etl_time", "source_system", "etl_batch"))
    t["ads_product_abc"] = store.write(
        "ads_product_abc", with_etl_columns(ranked), lambda f: layer_checks.product_classes(t["dws_product_sales"], f)
    )
    t["ads_product_abc_summary"] = store.write_small(
        "ads_product_abc_summary", abc.abc_summary(t["ads_product_abc"])
    )
    t |= star_layer(d, customer, product, source.statuses, store)
    return t


def quality_rows(bad: DataFrame, name: str) -> DataFrame:
    """A check that there are no such rows."""
    return reconcile.checks(bad.agg(F.count(F.lit(1)).alias("n")), [reconcile.compare(name, F.lit(0), F.col("n"))])


def star_layer(d, customer, product, statuses, store: LayerStore) -> dict[str, DataFrame]:
    """Facts and dimensions; their keys and partners have passed the gates."""
    facts = store.write(
        "fact_order", star.fact_order(d, statuses), lambda f: layer_checks.unique_key(f, "order_id", "fact_order")
    )

    def one_version(found: DataFrame) -> DataFrame:
        return quality_rows(found.where("versions > 1"), "conflicting_members")

    return {
        "fact_order": facts,
        "fact_order_detail": store.write("fact_order_detail", star.fact_order_detail(d)),
        "dim_customer": store.write("dim_customer", star.dim_customer(customer), one_version),
        "dim_product": store.write("dim_product", star.dim_product(product), one_version),
        "dim_date": store.write_small("dim_date", star.dim_date(facts)),
    }


@_dropping_shuffles
def order_warehouse(
    source,
    store: LayerStore,
    rules: quality.RuleSet | None = None,
    allowed: tuple[str, ...] = ALLOWED,
    strict_amounts: bool = False,
) -> dict[str, DataFrame]:
    """Rule report, order-driven wide table, basic subject tables and metrics, segments, star, each table checked."""
    t = typed_layer(source, store)
    gated(t, store, allowed)
    order = t["ods_order"].drop("etl_time", "source_system", "etl_batch")
    rules = rules or quality.RuleSet(
        keys=["order_id"],
        declared={"order_status": "string", "order_amount": "number", "payable_amount": "number"},
        null_columns=["order_id", "customer_id", "order_time", "order_status", "payable_amount"],
    )
    t["quality_report"] = store.write_small("quality_report", quality.rule_suite(order, rules))
    t["quality_score"] = store.write_small("quality_score", quality.quality_score(t["quality_report"]))
    t["quality_error_rows"] = store.write("quality_error_rows", quality.error_rows(order, rules))

    def wide_check(found: DataFrame) -> DataFrame:
        rows = layer_checks.wide_rows(order, t["ods_order_detail"], found)
        sold = found.filter(F.col("order_detail_id").isNotNull())
        return rows.unionByName(layer_checks.amounts(sold)) if strict_amounts else rows

    d = store.write_parts(
        "dwd_order_detail",
        wide.dwd_order_driven_parts(order, t["ods_order_detail"], t["ods_customer"], t["ods_product"]),
        wide_check,
    )
    t["dwd_order_detail"] = d
    valid = sales.valid_sales(d, source.statuses)
    grain = store.write(
        "dwd_valid_order", sales.order_grain(valid, GRAIN), lambda f: layer_checks.unique_key(f, "order_id", "dwd_valid_order")
    )
    t["dws_user_sales"] = store.write(
        "dws_user_sales", sales.user_sales_basic(grain), lambda f: reconcile.user_sales_checks(grain, f)
    )
    sold = valid.filter(F.col("order_detail_id").isNotNull())
    t["dws_product_sales"] = store.write(
        "dws_product_sales", sales.product_sales_basic(sold), lambda f: layer_checks.basic_products(sold, f)
    )
    dated = grain.filter(F.col("order_time").isNotNull())
    t["ads_sales_summary"] = store.write_small(
        "ads_sales_summary", sales.daily_sales_basic(grain), lambda f: reconcile.daily_sales_checks(dated, f)
    )
    t["ads_user_summary"] = store.write("ads_user_summary", sales.user_level(t["dws_user_sales"]))
    t["ads_product_summary"] = store.write(
        "ads_product_summary", abc.product_dense_ranks(t["dws_product_sales"])
    )
    base = store.write(
        "ads_user_rfm_base", rfm.rfm_base(t["dws_user_sales"]), lambda f: layer_checks.rfm_base(t["dws_user_sales"], f)
    )
    t["ads_user_rfm_segment"] = store.write(
        "ads_user_rfm_segment", rfm.segments(rfm.scores_by_percentile(base))
    )
    t["ads_user_rfm_segment_summary"] = store.write_small(
        "ads_user_rfm_segment_summary", rfm.segment_summary(t["ads_user_rfm_segment"])
    )
    t |= star_layer(d, t["ods_customer"], t["ods_product"], source.statuses, store)
    return t


def run(source, base: str, kind: str = "detail", strict_amounts: bool = False) -> DataFrame:
    """Build one warehouse below ``base``, raise if a check fails.

    A table that fails its own checks leaves the earlier one in place.
    ``strict_amounts`` also stops where order amounts are not the sum of their details.
    """
    kinds = {
        "detail": (detail_warehouse, reconcile.warehouse_checks_29),
        "order": (order_warehouse, reconcile.warehouse_checks_12),
    }
    if kind not in kinds:
        raise ValueError(f"unknown warehouse kind: {kind}")
    build, check = kinds[kind]
    store = LayerStore(source.spark, base)
    store.repair()
    with scratch_scope(source.spark), shuffles_dropped(source.spark):
        tables = build(source, store, strict_amounts=strict_amounts)
        result = store.write_small("quality_checks", check(tables, source.statuses))
    reconcile.require_all_passed(result)
    return result


def main() -> None:
    from martloom.sources.retail_csv import CleanedCsvTables, CsvTables

    p = argparse.ArgumentParser(description="Build a warehouse from four CSV tables.")
    p.add_argument("source", help="folder with order.csv, order_detail.csv, customer.csv, product.csv")
    p.add_argument("base", help="folder for the layer tables")
    p.add_argument("--kind", choices=("detail", "order"), default="detail")
    p.add_argument("--strict-amounts", action="store_true", help="stop where order and detail amounts disagree")
    args = p.parse_args()
    tables = CleanedCsvTables if args.kind == "order" else CsvTables
    run(tables(job_session(), args.source), args.base, args.kind, args.strict_amounts).show(50, truncate=False)


if __name__ == "__main__":
    main()
