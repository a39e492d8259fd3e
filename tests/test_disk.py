"""What the warehouses hold on disk while they are built, and what they leave."""

import os
import time

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from checks.compare import compare, connect
from martloom import session
from martloom.operators import wide
from martloom.plans.store import LayerStore
from martloom.sources import sinks


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (blocks.apply(i).getName() for i in range(blocks.size()))
    return {n for n in names if n.startswith("shuffle_")}


def staged(spark):
    return {f"{r}/{d}" for r, ds, _ in os.walk(session.scratch_root(spark).removeprefix("file:")) for d in ds}


def in_parts(monkeypatch, table, n=3):
    monkeypatch.setattr(wide, "PART_BYTES", wide.written_bytes(table) // n + 1)


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("key", ["warehouse_checks_29", "warehouse_checks_12", "layer_row_parity"])
def test_a_built_warehouse_leaves_its_check_rows_alone(spark, con, folder, key, monkeypatch):
    monkeypatch.setattr(wide, "PART_BYTES", 64 << 10)
    joined, real = [], wide.parts_by_order
    monkeypatch.setattr(wide, "parts_by_order", lambda *tables: joined.append(real(*tables)) or joined[-1])
    shuffled, before = shuffle_files(spark), staged(spark)
    assert compare(spark, con, folder, queries()[key], oracle_sql()[key]) == ""
    assert len(joined) == 1 and len(joined[0]) > 1
    new = {p.rsplit("/", 1)[1].split("-")[0] for p in staged(spark) - before}
    assert "checks" in new and not new & {"warehouse", "warehouse12", "ods", "dwd", "scope"}
    until = time.time() + 20  # executors delete on their own time
    while shuffle_files(spark) - shuffled and time.time() < until:
        time.sleep(0.2)
    assert shuffle_files(spark) - shuffled == set()


def test_shuffles_are_kept_again_afterwards(spark):
    before = spark.conf.get(session.DROP_SHUFFLES, None)
    with pytest.raises(KeyError), session.shuffles_dropped(spark):
        assert spark.conf.get(session.DROP_SHUFFLES) == "true"
        raise KeyError
    assert spark.conf.get(session.DROP_SHUFFLES, None) == before


@pytest.fixture
def members(spark, tmp_path):
    """Written tables: orders without details and without id, details without order and without id."""
    key = F.col("id")
    some = F.when(key % 17 > 0, key)
    order = spark.range(300).select(
        some.alias("order_id"), (key % 40).alias("customer_id"),
        *[F.concat(F.lit(f"{c}-"), key).alias(c) for c, _ in wide.ORDER_PART if c != "customer_id"],
    )
    detail = spark.range(1000).select(
        key.alias("order_detail_id"), F.when(key % 19 > 0, key % 350 + 50).alias("order_id"), (key % 30).alias("product_id"),
        *[F.concat(F.lit(f"{c}-"), key).alias(c) for c, _ in wide.DETAIL_PART if c not in ("order_detail_id", "order_id", "product_id")],
    )
    customer = spark.range(30).select(key.alias("customer_id"), *[F.concat(F.lit(f"{c}-"), key).alias(c) for c, _ in wide.CUSTOMER_PART])
    product = spark.range(25).select(key.alias("product_id"), *[F.concat(F.lit(f"{c}-"), key).alias(c) for c, _ in wide.PRODUCT_PART])
    tables = {"order": order, "detail": detail, "customer": customer, "product": product}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
    return {name: spark.read.parquet(f"{tmp_path}/{name}") for name in tables}


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_wide_table_in_parts_is_the_whole_one(spark, members, tmp_path, monkeypatch):
    m = members
    whole = wide.dwd_wide(m["detail"], m["order"], m["customer"], m["product"])
    in_parts(monkeypatch, m["detail"])
    parts = wide.dwd_wide_parts(m["detail"], m["order"], m["customer"], m["product"])
    assert len(parts) == 3 and all(p.count() > 0 for p in parts)
    written = LayerStore(spark, str(tmp_path / "w")).write_parts("dwd_x", parts)
    assert written.count() == 1000 and written.select("etl_time", "etl_batch").distinct().count() == 1
    assert written.dtypes == whole.dtypes
    assert same(written.drop("etl_time", "etl_batch"), whole.drop("etl_time", "etl_batch"))
    assert all(f.endswith(".zstd.parquet") for f in written.inputFiles())


def test_order_driven_table_in_parts_is_the_whole_one(members, monkeypatch):
    m = members
    tables = [m[n] for n in ("order", "detail", "customer", "product")]
    whole = wide.dwd_order_driven(*tables)
    in_parts(monkeypatch, m["detail"])
    parts = wide.dwd_order_driven_parts(*tables)
    assert len(parts) == 3 and all(p.count() > 0 for p in parts)
    added = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # Orders without id and without details stay.
    assert added.where("order_id IS NULL").count() == 18 and added.where("order_detail_id IS NULL").count() > 18
    assert same(added, whole)


def test_ids_of_two_types_stay_in_one_part(members, monkeypatch):
    in_parts(monkeypatch, members["detail"])
    text = members["order"].withColumn("order_id", F.col("order_id").cast("string"))
    assert len(wide.parts_by_order(members["order"], members["detail"])) == 3
    assert len(wide.parts_by_order(text, members["detail"])) == 1


def test_parts_of_a_write_are_counted_together(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(9).write.parquet(path)
    assert tuple(sinks.parquet_overwrite_verified(spark.range(3), path, spark.range(2), spark.range(0)).first()) == (5, 5)
    assert spark.read.parquet(path).count() == 5
