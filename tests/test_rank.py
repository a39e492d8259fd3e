"""The scaled ranking against the plain single-task window."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martloom.operators import abc, rank, rfm
from martloom.session import stage


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def skewed(spark, n=2000):
    """A third of the rows share one value; some values are NULL."""
    i = F.col("id")
    value = F.when(i % 3 == 0, 7).when(i % 17 == 0, None).otherwise((i * 7919) % 101)
    return spark.range(n).select("id", value.cast("decimal(18,2)").alias("v"))


@pytest.mark.parametrize("partitions", ["1", "2", "8"])
def test_global_rank_equals_window(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = skewed(spark)
        order = [F.desc("v"), F.asc("id")]
        got = rank.global_rank(df, order, running={"run": "v"}, total="n", grand={"all": "run"})
        w = Window.orderBy(*order)
        whole = Window.partitionBy()
        want = df.select(
            "id",
            "v",
            F.row_number().over(w).alias("rn"),
            F.count(F.lit(1)).over(whole).alias("n"),
            F.sum("v").over(whole).alias("all"),
            F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("run"),
        )
        assert rows(got.select(*want.columns)) == rows(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hot_value_is_cut_into_ranges(spark):
    df = spark.range(4000).select("id", F.lit(1).alias("v"))
    ranged = df.repartitionByRange(4, F.col("v"), F.col("id"))
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 6, 23])
def test_tile_scores_equal_sql_ntile(spark, n):
    """Ties, NULL values and fewer rows than tiles included."""
    value = lambda k: F.when(F.col("id") % 7 != k, F.col("id") % 4)
    df = spark.range(n).select(
        F.concat(F.lit("c"), F.col("id")).alias("customer_id"), value(1).alias("recency_days"),
        value(2).alias("frequency"), value(3).cast("decimal(18,2)").alias("monetary"),
    )
    got = rfm.scores_by_ntile(df).select("customer_id", "r_score", "f_score", "m_score")
    order = {"r_score": F.desc("recency_days"), "f_score": F.asc("frequency"), "m_score": F.asc("monetary")}
    want = df.select("customer_id", *[F.ntile(5).over(Window.orderBy(o, "customer_id")).alias(s) for s, o in order.items()])
    assert rows(got) == rows(want)


@pytest.mark.parametrize("partitions,n", [("1", 300), ("3", 300), ("8", 2000), ("8", 3), ("8", 0)])
def test_dense_ranks(spark, partitions, n):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = skewed(spark, n)
        got = rank.dense_ranks(df, "v", "dr", "id")
        want = df.select("id", "v", F.dense_rank().over(Window.orderBy(F.desc("v"))).alias("dr"))
        assert rows(got.select("id", "v", "dr")) == rows(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_running_sums_are_exact_and_large(spark):
    df = spark.range(500).select("id", (F.lit("123456789012345678901.23").cast("decimal(24,2)") * (F.col("id") - 250)).cast("decimal(30,2)").alias("v"))
    got = rank.global_rank(df, [F.asc("id")], running={"run": "v", "ids": "id"}, grand={"all": "run"})
    w = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.sum("v").over(w).alias("run"), F.sum("id").over(w).alias("ids"), F.sum("v").over(Window.partitionBy()).alias("all"))
    assert rows(got.select("id", "run", "ids", "all")) == rows(want)
    assert got.schema["run"].dataType == want.schema["run"].dataType and got.schema["ids"].dataType == want.schema["ids"].dataType
    with pytest.raises(TypeError):
        rank.global_rank(df.withColumn("d", F.lit(1.5)), [F.asc("id")], running={"x": "d"})


def shuffles(spark, tmp_path, monkeypatch, run):
    """Exchanges of rows (not of totals by range) in all plans written and in the result's."""
    plans = []

    def spied(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(rank, "stage", spied)
    plans.append(run()._jdf.queryExecution().executedPlan().toString())
    return [line for p in plans for line in p.split("\n") if "Exchange range" in line or "Exchange hash" in line or "SortMergeJoin" in line or "BroadcastHashJoin" in line]


def test_running_sums_and_dense_ranks_take_one_shuffle(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    spark.range(300).select("id", (F.col("id") % 7).cast("decimal(18,2)").alias("v")).write.parquet(path)
    df = spark.read.parquet(path)
    for run in (lambda: rank.global_rank(df, [F.desc("v"), "id"], running={"r": "v"}), lambda: rank.dense_ranks(df, "v", "d", "id")):
        found = shuffles(spark, tmp_path, monkeypatch, run)
        assert sum("rangepartitioning" in line for line in found) == 1
        # What else moves is one row per range.
        assert all("__part" in line or "__range" in line for line in found if "rangepartitioning" not in line)


def base_frame(spark, values):
    return spark.createDataFrame(
        values, "customer_id string, recency_days int, frequency bigint, monetary decimal(18,2)"
    )


def test_percentile_scores_keep_ties_together(spark):
    data = [("a", 1, 1, 10), ("b", 2, 1, 20), ("c", 3, 1, 30), ("d", 4, 1, 40), ("e", 5, 9, 50)]
    df = base_frame(spark, [(c, r, f, __import__("decimal").Decimal(m)) for c, r, f, m in data])
    got = {r.customer_id: (r.r_score, r.f_score, r.m_score, r.rfm_code) for r in rfm.scores_by_percentile(df).collect()}
    # frequency: four ties at average rank 2.5 of 5 -> ceil(2.5) = 3
    assert got == {
        "a": (5, 3, 1, "531"),
        "b": (4, 3, 2, "432"),
        "c": (3, 3, 3, "333"),
        "d": (2, 3, 4, "234"),
        "e": (1, 5, 5, "155"),
    }


def test_percentile_scores_do_not_drop_missing_values(spark):
    df = base_frame(spark, [("a", 1, 1, None), ("b", 2, 2, None), ("c", 3, 3, None)])
    done = rfm.segments(rfm.scores_by_percentile(df))
    assert done.count() == 3
    assert {r.user_segment for r in done.collect()} == {"未分类"}


def test_ntile_scores_with_few_users(spark):
    df = base_frame(spark, [("a", 9, 1, 1), ("b", 5, 2, 2), ("c", 1, 3, 3)] and [])
    assert rfm.scores_by_ntile(df).count() == 0


def test_abc_limits_are_inclusive(spark):
    data = [("p1", 1, 80), ("p2", 1, 15), ("p3", 1, 5)]
    df = spark.createDataFrame(data, "product_id string, sales_count bigint, sales_amount int").withColumn(
        "sales_amount", F.col("sales_amount").cast("decimal(38,2)")
    )
    got = {r.product_id: (r.sales_amount_rank, r.abc_level) for r in abc.product_ranking(df).collect()}
    assert got == {"p1": (1, "A类"), "p2": (2, "B类"), "p3": (3, "C类")}


def test_abc_needs_positive_total(spark):
    df = spark.createDataFrame([("p1", 1, 0)], "product_id string, sales_count bigint, sales_amount int").withColumn(
        "sales_amount", F.col("sales_amount").cast("decimal(38,2)")
    )
    with pytest.raises(Exception, match="above zero"):
        abc.product_ranking(df).collect()
