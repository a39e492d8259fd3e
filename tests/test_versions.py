"""Newest versions, months written aside and published, the merge of corrections."""

import datetime as dt
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from martloom.operators import versions
from martloom.sources import partitions, publish

T1, T2 = dt.datetime(2025, 1, 1), dt.datetime(2025, 2, 1, 10)
SCHEMA = "k string, v int, w string, record_update_time timestamp_ntz, record_source string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def newest_by_hand(rows):
    def place(r):
        return tuple((x is not None, x) if x is not None else (False,) for x in (r[3], r[4], r[1], r[2]))

    best = {}
    for r in rows:
        if r[0] not in best or place(r) > place(best[r[0]]):
            best[r[0]] = r
    return Counter(best.values())


def test_latest_version_equals_definition(spark):
    base = [(k, v, w, t, s) for k in ("a", "b", None) for v in (1, 2, None) for w in ("x", None) for t in (T1, T2) for s in ("ORIGINAL", None)]
    base += [("c", 1, "x", None, "ORIGINAL"), ("c", 2, None, None, "ORIGINAL"), ("d", 1, "x", T2, None), ("d", 9, "x", None, "Z")]
    delta = [("a", 0, "z", T2, "CORRECTED"), ("e", 0, "z", T2, "CORRECTED"), ("e", 0, "z", T2, "CORRECTED"), ("f", 1, "y", T2, "ORIGINAL-B"), ("f", 2, "y", T2, "ORIGINAL-A")]
    found = versions.latest_version(spark.createDataFrame(base, SCHEMA), spark.createDataFrame(delta, SCHEMA), "k")
    assert Counter(map(tuple, found.collect())) == newest_by_hand(base + delta)


def test_newest_is_a_hash_aggregate_and_a_hot_key_is_split(spark, tmp_path):
    path = str(tmp_path / "v")
    i = F.col("id")
    rows = spark.range(60_000).select(
        F.when(i % 3 == 0, "hot").otherwise(i.cast("string")).alias("k"), i.cast("int").alias("v"), F.rpad(i.cast("string"), 60, "x").alias("w"),
        (F.lit("2025-01-01").cast("timestamp_ntz") + F.make_dt_interval(i.cast("int") % 3)).alias("record_update_time"), F.lit("ORIGINAL").alias("record_source"),
    )
    rows.write.parquet(path)
    base = spark.read.parquet(path)
    found = versions.latest_version(base, base.limit(0), "k")
    assert "SortAggregate" not in plan(found) and "SortAggregate" not in plan(versions.merge_checks(base, base.limit(0), "k"))
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        assert found.count() == 40_001
        found = versions.latest_version(base, base.limit(0), "k")
        found.collect()
        assert "skew=true" in plan(found)
    finally:
        for key in small:
            spark.conf.unset(key)


def month_table(spark, path):
    i = F.col("id")
    rows = spark.range(400).select(
        i.cast("string").alias("k"), i.cast("int").alias("v"),
        (F.lit("2025-01-10").cast("timestamp_ntz") + F.make_ym_interval(F.lit(0), (i % 4).cast("int"))).alias("order_time"),
    )
    base = versions.versioned(rows, versions.ORIGINAL, F.lit(T1).cast("timestamp_ntz"))
    partitions.month_partition_write(base, path)
    return base


def corrections(spark, rows):
    frame = spark.createDataFrame(rows, "k string, v int, order_time timestamp_ntz")
    return versions.versioned(frame, versions.CORRECTED, F.lit(T2).cast("timestamp_ntz"))


def files(path):
    return {m: sorted(f for f in os.listdir(f"{path}/{m}") if f.startswith("part")) for m in os.listdir(path) if m.startswith("order_month=")}


MARCH, APRIL, MAY = (dt.datetime(2025, m, 20) for m in (3, 4, 5))


def test_upsert_rewrites_only_touched_months(spark, tmp_path):
    path = str(tmp_path / "m")
    month_table(spark, path)
    before = files(path)
    # 2 stands in March and stays, 6 moves from March to May, 1000 is new in April.
    out = partitions.upsert_months(corrections(spark, [("2", -2, MARCH), ("6", -6, MAY), ("1000", -1, APRIL)]), path, "k")
    assert {tuple(r) for r in out.collect()} == {("2025-03", 100, 99), ("2025-04", 100, 101), ("2025-05", 0, 1)}
    after = files(path)
    assert [m for m in before if after[m] == before[m]] == [m for m in before if m[-2:] in ("01", "02")]
    rows = {r.k: (r.v, r.order_month) for r in partitions.read_months(spark, path).collect()}
    assert len(rows) == 401 and rows["2"] == (-2, "2025-03") and rows["6"] == (-6, "2025-05") and rows["1000"] == (-1, "2025-04")
    assert publish.Folder(spark, path).names("_incoming") == [] and publish.Folder(spark, path).names("_outgoing") == []


def test_upsert_that_empties_a_month_and_nothing_to_do(spark, tmp_path):
    path = str(tmp_path / "m")
    partitions.month_partition_write(month_table(spark, str(tmp_path / "x")).where("k = '2'"), path)
    partitions.upsert_months(corrections(spark, [("2", 7, MAY)]), path, "k")
    assert list(files(path)) == ["order_month=2025-05"]
    assert partitions.upsert_months(corrections(spark, [("2", 7, MAY)]).limit(0), path, "k").count() == 0
    fresh = str(tmp_path / "fresh")
    partitions.upsert_months(corrections(spark, [("2", 7, MAY), ("3", 8, MAY)]), fresh, "k")
    assert partitions.read_months(spark, fresh).count() == 2


def test_failed_merge_check_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    month_table(spark, path)
    before = files(path)
    monkeypatch.setattr(versions, "latest_version", lambda base, delta, key: base.unionByName(delta))  # keeps both versions
    with pytest.raises(ValueError, match="merge failed"):
        partitions.upsert_months(corrections(spark, [("2", -2, MARCH)]), path, "k")
    assert files(path) == before and publish.Folder(spark, path).names("_incoming") == []
    with pytest.raises(ValueError, match="month"):
        partitions.upsert_months(corrections(spark, [("2", -2, None)]), path, "k")


def test_failed_check_of_a_month_leaves_the_old_one(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    base = month_table(spark, path)
    before = files(path)
    split = partitions._split
    monkeypatch.setattr(partitions, "_split", lambda s, p, m: (split(s, p, m)[0] + ("_incoming" in p), split(s, p, m)[1]))
    with pytest.raises(ValueError, match="failed"):
        partitions.incremental_month_job(base.where("v < 100"), "2025-02", path)
    assert files(path) == before and partitions.read_months(spark, path).count() == 400


@pytest.mark.parametrize("moves", range(4))
def test_crash_while_publishing_is_repaired(spark, tmp_path, monkeypatch, moves):
    path = str(tmp_path / "m")
    month_table(spark, path)
    move, done = publish.Folder.move, []

    def breaks(self, name, to):
        if len(done) == moves:
            raise KeyboardInterrupt
        done.append(name)
        move(self, name, to)

    monkeypatch.setattr(publish.Folder, "move", breaks)
    with pytest.raises(KeyboardInterrupt):
        partitions.upsert_months(corrections(spark, [("2", -2, MARCH), ("6", -6, MAY)]), path, "k")
    monkeypatch.setattr(publish.Folder, "move", move)
    # Before the marker nothing has happened, after it everything will.
    assert bool(publish.repair(spark, path)) == (moves > 0)
    rows = {r.k: r.v for r in partitions.read_months(spark, path).collect()}
    assert len(rows) == 400 and (rows["2"], rows["6"]) == ((-2, -6) if moves else (2, 6))
    assert publish.repair(spark, path) == [] and publish.Folder(spark, path).names("_outgoing") == []
