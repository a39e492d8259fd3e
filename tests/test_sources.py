"""Strict reads, verified writes, partitions, incremental months, layout."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from martloom.sources import layout, partitions, sinks, tables


def write_text(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_strict_csv_reads_text(spark, tmp_path):
    path = write_text(tmp_path / "a.csv", "id,name\n001,甲\n002,\n")
    df = tables.csv_strict_scan(spark, path, ["id", "name"])
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("001", "甲"), ("002", None)]
    assert {t for _, t in df.dtypes} == {"string"}


def test_strict_csv_accepts_a_byte_order_mark(spark, tmp_path):
    path = write_text(tmp_path / "a.csv", "﻿id,name\n1,x\n")
    assert tables.csv_strict_scan(spark, path, ["id", "name"]).count() == 1


@pytest.mark.parametrize("columns", [["name", "id"], ["id"], ["id", "name", "more"], ["ID", "name"]])
def test_strict_csv_rejects_other_headers(spark, tmp_path, columns):
    path = write_text(tmp_path / "a.csv", "id,name\n1,x\n")
    with pytest.raises(ValueError, match="expected"):
        tables.csv_strict_scan(spark, path, columns)


def test_strict_csv_checks_the_header_of_every_file(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    write_text(folder / "a.csv", "id,name\n1,x\n")
    write_text(folder / "b.csv", "name,id\ny,2\n")
    with pytest.raises(Exception, match="(?i)header|expected"):
        tables.csv_strict_scan(spark, str(folder), ["id", "name"]).collect()


@pytest.mark.parametrize("bad", ["1,x,extra", "1"])
def test_strict_csv_fails_on_malformed_rows_even_for_a_count(spark, tmp_path, bad):
    path = write_text(tmp_path / "a.csv", f"id,name\n0,ok\n{bad}\n")
    df = tables.csv_strict_scan(spark, path, ["id", "name"])
    with pytest.raises(Exception, match="(?i)malformed"):
        df.collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        df.select("id").collect()


def test_scratch_scope_removes_only_its_own_tables(spark):
    from martloom.session import scratch_scope, stage

    kept = stage(spark.range(3).toDF("a"), "kept")
    with scratch_scope(spark):
        inner = stage(spark.range(5).toDF("a"), "inner")
        path = inner.inputFiles()[0]
        assert inner.count() == 5
    assert kept.count() == 3
    assert not tables.path_exists(spark, path)


def test_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="ods_order"):
        tables.parquet_scan_checked(spark, str(tmp_path), "ods_order")


def test_profile(spark):
    df = spark.range(100).repartition(3)
    assert tuple(tables.table_profile(df, 100).first()) == (100, 3, 1, "id bigint", True)
    assert tables.table_profile(df, 99).first().ok is False


def test_overwrite_is_verified_and_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame(
        [("C1", "A", 10.5), ("C2", "B", 20.0)], "customer_id string, customer_name string, total_amount double"
    )
    assert tuple(sinks.parquet_overwrite_verified(frame, path).first()) == (2, 2)
    assert tuple(sinks.parquet_overwrite_verified(frame.limit(1), path).first()) == (1, 1)


def test_writing_nothing(spark, tmp_path):
    empty = spark.range(10).filter("id < 0").groupBy("id").count()
    assert tuple(sinks.parquet_overwrite_verified(empty, str(tmp_path / "a")).first()) == (0, 0)
    assert tuple(sinks.small_result_sink(empty, str(tmp_path / "b")).first()) == (0, 0)


def test_small_result_is_one_file(spark, tmp_path):
    path = str(tmp_path / "t")
    grouped = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    assert tuple(sinks.small_result_sink(grouped, path).first()) == (7, 7)
    assert layout.table_files(spark, path).count() == 1


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv")
    frame = spark.createDataFrame([("C1", "甲", 10.5), ("C2", None, 20.0)], "customer_id string, customer_name string, total_amount double")
    sinks.csv_sink(frame, path)
    back = tables.csv_strict_scan(spark, path, frame.columns)
    assert sorted(map(tuple, back.collect())) == [("C1", "甲", "10.5"), ("C2", None, "20.0")]


# ---- months --------------------------------------------------------------


def months_frame(spark):
    times = [datetime(2025, 1, 31, 23, 59, 59), datetime(2025, 2, 1), datetime(2025, 2, 28), datetime(2025, 12, 31), None]
    return spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, order_time timestamp_ntz")


def counts(df):
    return {r.order_month: r.row_count for r in df.collect()}


def test_months_without_time_are_reported_and_not_written(spark, tmp_path):
    df = months_frame(spark)
    assert counts(partitions.month_rows(df)) == {"2025-01": 1, "2025-02": 2, "2025-12": 1, None: 1}
    written = partitions.month_partition_write(df, str(tmp_path / "m"))
    assert counts(written) == {"2025-01": 1, "2025-02": 2, "2025-12": 1, None: 1}


def test_month_scan_is_pruned(spark, tmp_path):
    path = str(tmp_path / "m")
    partitions.month_partition_write(months_frame(spark), path)
    df = partitions.month_pruned_scan(spark, path, "2025-02")
    assert df.count() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    line = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "PartitionFilters: [isnotnull(order_month" in line
    assert len(df.inputFiles()) >= 1 and "order_month=2025-02" in "".join(
        r.f for r in df.select(F.input_file_name().alias("f")).distinct().collect()
    )


def test_in_month_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    months_frame(spark).write.parquet(path)
    df = partitions.in_month(spark.read.parquet(path), "2025-12")
    assert df.count() == 1
    assert "GreaterThanOrEqual(order_time" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("month", ["2025-13", "2025-00", "2025-1", "202501", "2025-01-01", "", "0000-01"])
def test_bad_months(month):
    with pytest.raises(ValueError):
        partitions.check_month(month)


def test_incremental_month_twice_gives_the_same(spark, tmp_path):
    path, df = str(tmp_path / "m"), months_frame(spark)
    first = partitions.incremental_month_job(df, "2025-01", path)
    assert all(r.passed for r in first.collect())
    for _ in range(2):
        checks = {r.check_name: r.actual for r in partitions.incremental_month_job(df, "2025-02", path).collect()}
        assert checks == {"target_month": 2, "other_months": 1, "total": 3}
    assert counts(partitions.partition_rows(spark, path)) == {"2025-01": 1, "2025-02": 2}


def test_incremental_month_without_rows_changes_nothing(spark, tmp_path):
    path, df = str(tmp_path / "m"), months_frame(spark)
    partitions.month_partition_write(df, path)
    with pytest.raises(ValueError, match="no rows"):
        partitions.incremental_month_job(df, "2024-07", path)
    assert sum(counts(partitions.partition_rows(spark, path)).values()) == 4


# ---- layout --------------------------------------------------------------


def test_layout_audit_and_compaction(spark, tmp_path):
    many, few = str(tmp_path / "many"), str(tmp_path / "few")
    spark.range(120).repartition(12).write.parquet(many)
    before = layout.file_layout_audit(spark, {"many": many}).first()
    assert (before.files, before.row_count, before.small_files, before.broadcastable) == (12, 120, True, True)
    half = -(-before.bytes // 2)
    for mode in ("repartition", "coalesce"):
        r = layout.small_file_compaction(spark, many, few, mode, target_bytes=half).first()
        assert (r.files, r.rows_before, r.rows_after) == (2, 120, 120)
    assert layout.file_layout_audit(spark, {"few": few}).first().small_files is False
    with pytest.raises(ValueError):
        layout.small_file_compaction(spark, many, many, "coalesce")


def test_compaction_keeps_neighbours_together_and_does_not_grow(spark, tmp_path):
    many, few, one = (str(tmp_path / n) for n in ("many", "few", "one"))
    note = F.sha1(F.floor(F.col("id") / 50).cast("string"))
    spark.range(0, 90_000, 1, 9).withColumn("note", note).write.parquet(many)
    rows = spark.read.parquet(many)
    size = layout.table_files(spark, many).agg(F.sum("length")).first()[0]
    for source, target, mode, part, files in ((many, few, "repartition", -(-size // 3), 3), (few, one, "coalesce", size, 1)):
        r = layout.small_file_compaction(spark, source, target, mode, part).first()
        assert (r.files, r.rows_before, r.rows_after) == (files, 90_000, 90_000)
        written = spark.read.parquet(target)
        assert written.schema == rows.schema and written.exceptAll(rows).isEmpty()
        stretches = written.groupBy("_metadata.file_path").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("id").alias("n"))
        assert all(s.z - s.a + 1 == s.n == 90_000 // files for s in stretches.collect())
        assert layout.table_files(spark, target).agg(F.sum("length")).first()[0] <= size


def test_compaction_of_files_with_a_row_each_and_of_no_rows(spark, tmp_path):
    many, few, none = (str(tmp_path / n) for n in ("many", "few", "none"))
    spark.range(0, 12, 1, 12).write.parquet(many)
    size = layout.table_files(spark, many).agg(F.sum("length")).first()[0]
    r = layout.small_file_compaction(spark, many, few, "repartition", -(-size // 5)).first()
    assert (r.files, r.rows_before, r.rows_after) == (5, 12, 12)
    assert layout.footers(spark, few).agg(F.max("row_count")).first()[0] == 3
    spark.range(0).write.parquet(none)
    r = layout.small_file_compaction(spark, none, few, "repartition").first()
    assert (r.files, r.rows_before, r.rows_after) == (1, 0, 0)
