"""Queries on tables that are larger, or lie in more files, than the test tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from checks.compare import compare, connect
from martloom import session
from martloom.functions import fixed
from martloom.sources import partitions


def test_layout_audit_equals_its_sql_beyond_the_broadcast_size(spark, tmp_path):
    root, key = str(tmp_path), F.col("id")
    customer = spark.range(150_000).select(
        key.alias("c_custkey"), F.sha2(key.cast("string"), 256).alias("c_name"), (key % 25).cast("int").alias("c_nationkey"),
        key.cast("double").alias("c_acctbal"), F.concat(F.lit("S"), key % 5).alias("c_mktsegment"),
    )
    customer.repartition(3).write.parquet(f"{root}/customer.parquet")
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").coalesce(1).write.parquet(f"{root}/nation.parquet")
    con = duckdb.connect()
    # The model's other tables are named by the SQL, not read by this query.
    for name in ("orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{name}.parquet')")
    for name in ("customer", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet/*.parquet')")
    assert compare(spark, con, root, queries()["file_layout_audit"], oracle_sql()["file_layout_audit"]) == ""


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


KEYS = ["dwd_wide", "dwd_order_driven", "parquet_overwrite_verified", "dynamic_partition_overwrite", "incremental_month_job", "warehouse_checks_12"]


@pytest.mark.parametrize("key", KEYS)
def test_results_are_the_same_where_nothing_is_small(spark, con, folder, key, monkeypatch):
    """Products and the month's orders count as too large to broadcast."""
    monkeypatch.setattr(fixed, "BROADCAST_MB", 0)
    assert compare(spark, con, folder, queries()[key], oracle_sql()[key]) == ""


def test_large_products_meet_the_details_first_and_ids_are_made_last(spark, folder, monkeypatch):
    monkeypatch.setattr(fixed, "BROADCAST_MB", 0)
    plan = queries()["dwd_wide"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    # From the top: the join with the orders, below it the one with the products; the id is made above both.
    orders, products, ids = plan.index("= o_order_id"), plan.index("= p_product_id"), plan.index("concat_ws(-")
    assert ids < orders < products


def test_month_rows_are_dealt_out_without_derived_columns(spark, folder, monkeypatch):
    written, real = [], partitions.observed
    monkeypatch.setattr(partitions, "observed", lambda df: written.append(df) or real(df))
    queries()["month_partition_write"](spark, folder)
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("concat_ws(-") < plan.index("RebalancePartitions")


def test_tasks_get_a_bounded_share_of_a_join(spark):
    session.tune(spark)
    assert int(spark.conf.get(session.ADVISORY).rstrip("b")) == session.TASK_BYTES
    assert int(spark.conf.get(session.INITIAL)) == 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    with session.file_sized(spark):  # files keep their size
        assert int(spark.conf.get(session.ADVISORY)) == session.FILE_BYTES
    assert int(spark.conf.get(session.ADVISORY).rstrip("b")) == session.TASK_BYTES
