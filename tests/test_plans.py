"""What the physical plans must look like at scale."""

import contextlib
import re

from pyspark.sql import functions as F

from checks.q_sales import products, valid_orders, wide_table
from checks.registry import Tables
from martloom.functions.columns import meets
from martloom.operators import abc, quality, rfm, sales


@contextlib.contextmanager
def conf(spark, **settings):
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_valid_filter_and_columns_reach_the_scan(spark, folder):
    t = Tables(spark, folder)
    text = plan(sales.daily_sales(valid_orders(t)))
    scan = next(x for x in text.splitlines() if "FileScan" in x and "o_orderkey" in x)
    assert "In(o_orderstatus, [F,O])" in scan or "In(o_orderstatus, [O,F])" in scan
    assert "o_orderpriority" not in scan
    details = next(x for x in text.splitlines() if "FileScan" in x and "l_orderkey" in x)
    assert "ReadSchema: struct<l_orderkey:bigint>" in details


def test_channel_projection_has_no_exchange(spark, folder):
    t = Tables(spark, folder)
    assert "Exchange" not in plan(sales.channel_projection(t.clean.order(), t.statuses))


def _unpartitioned_windows(text):
    """Exchanges to a single partition that carry rows rather than partial sums."""
    lines = text.splitlines()
    partial = r"HashAggregate|SortAggregate\(key=\[\], functions=\[partial_"
    return [i for i, x in enumerate(lines) if re.search(r"Exchange SinglePartition", x) and not re.search(partial, lines[i + 1])]


def test_ranking_moves_no_rows_to_one_task(spark, folder):
    t = Tables(spark, folder)
    ranked = abc.product_ranking(products(t))
    assert "Exchange SinglePartition" in plan(ranked)  # the table of range sizes
    assert not _unpartitioned_windows(plan(ranked))
    scored = rfm.scores_by_ntile(rfm.rfm_base(sales.user_sales(valid_orders(t), t.clean.customer())))
    assert not _unpartitioned_windows(plan(scored))


def test_no_python_in_any_hot_path(spark, folder):
    t = Tables(spark, folder)
    for df in (wide_table(t), abc.product_ranking(products(t)), sales.area_sales(valid_orders(t, True))):
        assert "Python" not in plan(df) and "Pandas" not in plan(df)


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


def hot_details(spark, tmp_path):
    """A third of all details belong to one order; written as several files."""
    path = str(tmp_path / "details")
    i = F.col("id")
    spark.range(0, 60000, 1, 6).select(
        F.when(i % 3 == 0, -1).otherwise(i % 20000).alias("order_id"),
        F.timestamp_seconds(i).cast("timestamp_ntz").alias("created_at"),
        i.alias("order_detail_id"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def hot_orders(spark, tmp_path):
    path = str(tmp_path / "orders")
    spark.range(-1, 20000, 1, 6).select(
        F.col("id").alias("order_id"), F.timestamp_seconds(F.lit(30000)).cast("timestamp_ntz").alias("order_time")
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_hot_order_is_split_when_joined_to_grouped_orders(spark, tmp_path):
    details, orders = hot_details(spark, tmp_path), hot_orders(spark, tmp_path)
    with conf(spark, **SKEW):
        late = quality.detail_time_order(details, orders)
        text = final_plan(late)
        assert late.count() == 30000
    assert "skew=true" in text


def test_plain_equality_would_not_be_split(spark, tmp_path):
    """Why ``meets`` exists: the grouping's partitioning is reused by ``==``."""
    details = hot_details(spark, tmp_path)
    times = quality.order_times(hot_orders(spark, tmp_path))
    with conf(spark, **SKEW):
        plain = final_plan(details.join(times, F.col("order_id") == F.col("t_order_id"), "left"))
        safe = final_plan(details.join(times, meets("order_id", "t_order_id"), "left"))
    assert "skew=true" not in plain and "skew=true" in safe


def test_hot_orphan_is_split(spark, tmp_path):
    details = hot_details(spark, tmp_path)
    with conf(spark, **SKEW):
        lost = quality.orphans(details, hot_orders(spark, tmp_path).filter("order_id >= 0"), "order_id")
        text = final_plan(lost)
        assert lost.count() == 20000
    assert "skew=true" in text
