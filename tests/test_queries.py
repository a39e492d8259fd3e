"""Every registered query against its SQL, row for row, on whole tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import compare, connect
from checks.registry import QUERIES

KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(KEYS) <= set(oracle_sql()) and set(KEYS) <= set(queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, con, folder, key):
    assert compare(spark, con, folder, queries()[key], oracle_sql()[key]) == ""


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("partitions", ["1", "7"])
@pytest.mark.parametrize("key", ["rfm_scores_ntile", "product_ranking_abc", "dws_product_sales", "numeric_summary"])
def test_result_does_not_depend_on_partition_count(spark, con, folder, key, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert compare(spark, con, folder, queries()[key], oracle_sql()[key]) == ""
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
