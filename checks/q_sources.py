"""Scans, sinks, partitions, layout; typing and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.model_sql import VALID
from checks.registry import Tables, query
from checks.text_tables import text_detail, text_order, with_text
from martloom.functions import fixed
from martloom.functions.columns import is_blank, with_etl_columns
from martloom.operators import clean, rank, sales, versions, wide
from martloom.sources import layout, partitions, retail, schemas, sinks, tables

MONTH = "1997-05"


def _orders(t: Tables):
    return sales.orders_with_details(t.clean.order(), t.clean.detail())


def _valid_orders(t: Tables):
    return sales.orders_with_details(sales.valid_sales(t.clean.order(), t.statuses), t.clean.detail())


def _detail_with_time(t: Tables):
    return retail.derived_detail(_lines_with_time(t))


def _lines_with_time(t: Tables):
    """Source columns of the details with time and status of their orders."""
    order = t.clean.order().select("order_id", "order_time", "order_status")
    return t.clean.detail_source().join(order, "order_id", "left")


def _month_lines(t: Tables):
    """The valid lines of one month. Its orders are found first; while they are few, the lines of all others are not dealt out."""
    order = partitions.in_month(sales.valid_sales(t.clean.order(), t.statuses), MONTH).select("order_id", "order_time", "order_status")
    found = t.stage(order, "month-orders")
    if wide.written_bytes(found) <= fixed.BROADCAST_MB << 20:
        found = F.broadcast(found)
    return t.clean.detail_source().join(found, "order_id")


@query(
    "csv_strict_scan",
    "order_id:s customer_id:s order_time:s order_status:s payable_amount:s",
    with_text("SELECT order_id, customer_id, order_time, trim(order_status) AS order_status, payable_amount FROM text_order"),
)
def csv_strict_scan(t: Tables):
    path = t.scratch("orders-csv")
    sinks.csv_sink(clean.trim_text(text_order(t)), path)
    return tables.csv_strict_scan(t.spark, path, schemas.ORDER)


@query(
    "table_profile",
    "row_count:i columns:i schema:s ok:b",
    """SELECT count(*) AS row_count, (SELECT count(*) FROM (DESCRIBE orders)) AS columns,
    (SELECT string_agg(column_name || ' ' || CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
      WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END, ', ') FROM (DESCRIBE orders)) AS schema,
    count(*) = (SELECT 10 * count(*) FROM customer) AS ok FROM orders""",
)
def table_profile(t: Tables):
    """Ten orders are expected for each customer."""
    return tables.table_profile(t.clean.raw("orders"), 10 * t.clean.raw("customer").count())


@query(
    "table_preview",
    "row_key:s status:s total:d",
    "SELECT CAST(o_orderkey AS VARCHAR) AS row_key, o_orderstatus AS status, o_totalprice AS total FROM orders ORDER BY o_orderkey LIMIT 5",
)
def table_preview(t: Tables):
    row = F.col("row")
    return tables.table_preview(t.clean.raw("orders"), "o_orderkey").select(
        "row_key", F.get_json_object(row, "$.o_orderstatus").alias("status"), F.get_json_object(row, "$.o_totalprice").alias("total")
    )


@query(
    "parquet_scan_checked",
    "l_returnflag:s row_count:i",
    "SELECT l_returnflag, count(*) AS row_count FROM lineitem GROUP BY l_returnflag",
)
def parquet_scan_checked(t: Tables):
    found = tables.parquet_scan_checked(t.spark, t.folder, "lineitem.parquet")
    return found.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "parquet_overwrite_verified",
    "rows_before:i rows_after:i",
    "SELECT count(*) AS rows_before, count(*) AS rows_after FROM wide",
)
def parquet_overwrite_verified(t: Tables):
    c = t.clean
    d = wide.dwd_wide(c.detail_source(), c.order(with_area=True), c.customer(), c.product(), retail.derived_detail)
    return sinks.parquet_overwrite_verified(d, t.scratch("dwd"))


@query(
    "small_result_sink",
    "rows_before:i rows_after:i",
    "SELECT count(*) AS rows_before, count(*) AS rows_after FROM daily",
)
def small_result_sink(t: Tables):
    return sinks.small_result_sink(sales.daily_sales(_valid_orders(t)), t.scratch("daily"))


@query(
    "csv_sink",
    "order_date:s order_count:s sales_amount:d",
    "SELECT strftime(order_date, '%Y-%m-%d') AS order_date, CAST(order_count AS VARCHAR) AS order_count, sales_amount FROM daily",
)
def csv_sink(t: Tables):
    path = t.scratch("daily-csv")
    daily = sales.daily_sales_basic(_valid_orders(t))
    sinks.csv_sink(daily, path)
    return tables.csv_strict_scan(t.spark, path, daily.columns)


_PER_MONTH = "SELECT strftime(order_time, '%Y-%m') AS order_month, count(*) AS row_count FROM wide WHERE order_time IS NOT NULL GROUP BY 1"


@query("month_partition_write", "order_month:s row_count:i", _PER_MONTH)
def month_partition_write(t: Tables):
    return partitions.month_partition_write(_lines_with_time(t), t.scratch("months"), retail.derived_detail)


@query(
    "month_write_with_unplaced",
    "order_month:s row_count:i",
    """SELECT CASE WHEN order_id % 137 > 0 THEN strftime(order_time, '%Y-%m') END AS order_month, count(*) AS row_count
    FROM m_order GROUP BY 1""",
)
def month_write_with_unplaced(t: Tables):
    """Some orders have no time; they are counted, not lost in silence."""
    timed = F.when(F.col("order_id") % 137 > 0, F.col("order_time"))
    return partitions.month_partition_write(t.clean.order().withColumn("order_time", timed), t.scratch("months"))


@query(
    "month_pruned_scan",
    "order_month:s row_count:i amount:d",
    f"""SELECT strftime(order_time, '%Y-%m') AS order_month, count(*) AS row_count, sum(actual_amount) AS amount
    FROM wide WHERE strftime(order_time, '%Y-%m') = '{MONTH}' GROUP BY 1""",
)
def month_pruned_scan(t: Tables):
    path = t.scratch("months")
    partitions.month_partition_write(_lines_with_time(t), path, retail.derived_detail)
    month = partitions.month_pruned_scan(t.spark, path, MONTH)
    return month.groupBy("order_month").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("actual_amount").alias("amount")
    )


@query(
    "dynamic_partition_overwrite",
    "order_month:s row_count:i",
    f"""SELECT strftime(order_time, '%Y-%m') AS order_month, count(*) AS row_count FROM wide
    WHERE strftime(order_time, '%Y-%m') <> '{MONTH}' OR order_status IN {VALID} GROUP BY 1""",
)
def dynamic_partition_overwrite(t: Tables):
    path = t.scratch("months")
    partitions.month_partition_write(_lines_with_time(t), path, retail.derived_detail)
    partitions.dynamic_partition_overwrite(_month_lines(t), MONTH, path, retail.derived_detail)
    return partitions.partition_rows(t.spark, path)


@query(
    "incremental_month_job",
    "check_name:s expected:i actual:i passed:b",
    f"""WITH c AS (SELECT count(*) FILTER (WHERE strftime(order_time, '%Y-%m') = '{MONTH}' AND order_status IN {VALID}) AS inc,
      count(*) FILTER (WHERE strftime(order_time, '%Y-%m') <> '{MONTH}') AS other FROM wide)
    SELECT 'target_month' AS check_name, inc AS expected, inc AS actual, true AS passed FROM c
    UNION ALL SELECT 'other_months', other, other, true FROM c
    UNION ALL SELECT 'total', inc + other, inc + other, true FROM c""",
)
def incremental_month_job(t: Tables):
    path = t.scratch("months")
    partitions.month_partition_write(_lines_with_time(t), path, retail.derived_detail)
    return partitions.incremental_month_job(_month_lines(t), MONTH, path, retail.derived_detail)


@query(
    "upsert_months",
    "order_month:s row_count:i amount:d corrected_rows:i",
    f"""WITH delta AS (SELECT order_detail_id, actual_amount + 1 AS actual_amount,
      CASE WHEN order_id % 5 = 0 THEN order_time + INTERVAL 1 MONTH ELSE order_time END AS order_time, 1 AS corrected
      FROM wide WHERE strftime(order_time, '%Y-%m') = '{MONTH}' AND quantity >= 40),
    merged AS (SELECT * FROM delta UNION ALL SELECT order_detail_id, actual_amount, order_time, 0 FROM wide
      WHERE order_time IS NOT NULL AND order_detail_id NOT IN (SELECT order_detail_id FROM delta))
    SELECT strftime(order_time, '%Y-%m') AS order_month, count(*) AS row_count, sum(actual_amount) AS amount, sum(corrected) AS corrected_rows
    FROM merged GROUP BY 1""",
)
def upsert_months(t: Tables):
    """Some lines of one month are corrected, a part of them moves to the next month."""
    path, time = t.scratch("months"), "2025-{}-01 00:00:00"
    columns = ("order_detail_id", "order_id", "quantity", "actual_amount", "order_time")
    rows = _detail_with_time(t).select(*columns)
    base = versions.versioned(rows, versions.ORIGINAL, F.lit(time.format("01")).cast("timestamp_ntz"))
    partitions.month_partition_write(base, path)
    moved = F.when(F.col("order_id") % 5 == 0, F.col("order_time") + F.expr("INTERVAL 1 MONTH")).otherwise(F.col("order_time"))
    fixed_up = partitions.in_month(rows, MONTH).filter(F.col("quantity") >= 40).withColumns(
        {"actual_amount": (F.col("actual_amount") + 1).cast("decimal(18,2)"), "order_time": moved}
    )
    delta = versions.versioned(fixed_up, versions.CORRECTED, F.lit(time.format("02")).cast("timestamp_ntz"))
    partitions.upsert_months(delta, path, "order_detail_id")
    return partitions.read_months(t.spark, path).groupBy("order_month").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("actual_amount").alias("amount"),
        F.count(F.when(F.col("record_source") == versions.CORRECTED, 1)).alias("corrected_rows"),
    )


# The audited tables are written plain (no dictionary, no compression), so their bytes follow from the values: a number takes
# its width, a text four bytes and its own. What Parquet adds (page headers, footers) is under one in a hundred of a MB or more.
_PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}
_KEYED = "8 + 4 + octet_length(encode(c_name)) + 4 + 8"  # c_custkey, c_name, c_nationkey, c_acctbal
_SIZES = f"""sizes AS (SELECT count(*) AS n, sum({_KEYED}) AS keyed, sum({_KEYED} + 4 + octet_length(encode(c_mktsegment))) AS whole FROM customer),
    segments AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment)"""


@query(
    "file_layout_audit",
    "table_name:s present:b files:i partitions:i row_count:i largest_file_rows:i small_files:b broadcastable:b",
    f"""WITH {_SIZES}
    SELECT 'many' AS table_name, true AS present, least(n, 12) AS files, 1 AS partitions, n AS row_count, CAST(ceil(n / 12) AS BIGINT) AS largest_file_rows,
      least(n, 12) >= {fixed.SMALL_FILE_COUNT} AND whole < least(n, 12) * {fixed.SMALL_FILE_MB << 20} AS small_files, whole <= {fixed.BROADCAST_MB << 20} AS broadcastable FROM sizes
    UNION ALL SELECT 'by_segment', true, count(*), count(*), sum(s.n), max(s.n), count(*) >= {fixed.SMALL_FILE_COUNT} AND any_value(keyed) < count(*) * {fixed.SMALL_FILE_MB << 20},
      any_value(keyed) <= {fixed.BROADCAST_MB << 20} FROM segments AS s, sizes
    UNION ALL SELECT 'one', true, 1, 1, count(*), count(*), false, true FROM nation
    UNION ALL SELECT 'missing', false, 0, 0, 0, 0, false, false""",
)
def file_layout_audit(t: Tables):
    """Tables written here with known files: rows dealt evenly to twelve, one file per segment, one file, none."""
    customer, paths = t.clean.raw("customer"), {n: t.scratch(n) for n in ("many", "by_segment", "one", "missing")}
    # Numbered first: a round robin begins anew in every input partition and leaves uneven files.
    dealt = rank.global_rank(customer, [F.asc("c_custkey")], rank="__rn")
    dealt.repartitionById(12, (F.col("__rn") % 12).cast("int")).drop("__rn").write.options(**_PLAIN).parquet(paths["many"])
    customer.repartition("c_mktsegment").write.options(**_PLAIN).partitionBy("c_mktsegment").parquet(paths["by_segment"])
    t.clean.raw("nation").coalesce(1).write.parquet(paths["one"])
    return layout.file_layout_audit(t.spark, paths)


@query(
    "small_file_compaction",
    "mode:s files:i rows_before:i rows_after:i",
    """SELECT 'repartition' AS mode, 3 AS files, count(*) AS rows_before, count(*) AS rows_after FROM lineitem
    UNION ALL SELECT 'coalesce', 1, count(*), count(*) FROM lineitem""",
)
def small_file_compaction(t: Tables):
    """To files of a third of the bytes, and of those to one."""
    source, spread, merged = f"{t.folder}/lineitem.parquet", t.scratch("spread"), t.scratch("merged")
    size = layout.table_files(t.spark, source).agg(F.sum("length").alias("bytes")).first().bytes
    first = layout.small_file_compaction(t.spark, source, spread, "repartition", -(-size // 3))
    return first.unionByName(layout.small_file_compaction(t.spark, spread, merged, "coalesce", 1 << 40))


_VIEW_SQL = """SELECT order_channel, count(*) AS order_count, sum(payable_amount) AS sales_amount
    FROM {o} WHERE order_status IN ('O', 'F') GROUP BY order_channel"""


@query("sql_views", "order_channel:s order_count:i sales_amount:d", _VIEW_SQL.format(o="m_order"))
def sql_views(t: Tables):
    tables.sql_views(
        {
            "retail_order": t.clean.order(),
            "retail_order_detail": t.clean.detail(),
            "retail_customer": t.clean.customer(),
            "retail_product": t.clean.product(),
        }
    )
    return t.spark.sql(_VIEW_SQL.format(o="retail_order"))


# ---- typing and cleaning -------------------------------------------------


@query(
    "uncastable_counts",
    "column_name:s bad:i",
    with_text(
        """SELECT 'quantity' AS column_name, count(*) FILTER (WHERE TRY_CAST(quantity AS INTEGER) IS NULL) AS bad FROM text_detail
    UNION ALL SELECT 'unit_price', 0
    UNION ALL SELECT 'discount_amount', 0
    UNION ALL SELECT 'actual_amount', count(*) FILTER (WHERE TRY_CAST(actual_amount AS DECIMAL(18,2)) IS NULL) FROM text_detail
    UNION ALL SELECT 'created_at', count(*) FILTER (WHERE TRY_CAST(created_at AS TIMESTAMP) IS NULL) FROM text_detail"""
    ),
)
def uncastable_counts(t: Tables):
    return clean.uncastable_counts(text_detail(t), schemas.ORDER_DETAIL)


@query(
    "ods_typed",
    "order_detail_id:s quantity:d actual_amount:d created_at:t",
    with_text(
        """SELECT order_detail_id, TRY_CAST(quantity AS INTEGER) AS quantity,
    TRY_CAST(actual_amount AS DECIMAL(18,2)) AS actual_amount, TRY_CAST(created_at AS TIMESTAMP) AS created_at FROM text_detail"""
    ),
)
def ods_typed(t: Tables):
    return clean.ods_typed(text_detail(t), schemas.ORDER_DETAIL)


@query(
    "etl_columns",
    "order_status:s source_system:s row_count:i one_instant:b batch_digits:i",
    """SELECT order_status, 'ecommerce' AS source_system, count(*) AS row_count, true AS one_instant, 14 AS batch_digits
    FROM m_order GROUP BY order_status""",
)
def etl_columns(t: Tables):
    loaded = with_etl_columns(t.clean.order())
    return loaded.groupBy("order_status", "source_system").agg(
        F.count(F.lit(1)).alias("row_count"),
        (F.min("etl_time") == F.max("etl_time")).alias("one_instant"),
        F.max(F.length("etl_batch")).alias("batch_digits"),
    )


_COERCED = """SELECT order_detail_id, TRY_CAST(actual_amount AS DECIMAL(18,2)) AS actual_amount,
    TRY_CAST(created_at AS TIMESTAMP) AS created_at FROM text_detail"""


@query("coerce_types", "order_detail_id:s actual_amount:d created_at:t", with_text(_COERCED))
def coerce_types(t: Tables):
    return clean.coerce_types(text_detail(t))


@query(
    "fill_money_zero",
    "order_detail_id:s actual_amount:d",
    with_text(
        "SELECT order_detail_id, coalesce(TRY_CAST(actual_amount AS DECIMAL(18,2)), 0) AS actual_amount FROM text_detail"
    ),
)
def fill_money_zero(t: Tables):
    return clean.fill_money_zero(text_detail(t))


@query(
    "trim_text",
    "order_id:s order_status:s",
    with_text("SELECT order_id, trim(order_status) AS order_status FROM text_order"),
)
def trim_text(t: Tables):
    return clean.trim_text(text_order(t))


@query(
    "drop_exact_duplicates",
    "order_id:s customer_id:s payable_amount:d",
    "SELECT DISTINCT order_id, customer_id, payable_amount FROM f_order",
)
def drop_exact_duplicates(t: Tables):
    return clean.drop_exact_duplicates(t.faulty.order())


@query(
    "removed_duplicates",
    "order_id:s removed_copies:i",
    "SELECT order_id, count(*) - 1 AS removed_copies FROM f_order GROUP BY order_id HAVING count(*) > 1",
)
def removed_duplicates(t: Tables):
    return clean.removed_duplicates(t.faulty.order())


@query(
    "clean_table",
    "order_id:s customer_id:s order_status:s coupon_amount:d payable_amount:d order_time:t",
    with_text(
        """SELECT DISTINCT order_id, customer_id, trim(order_status) AS order_status,
    coalesce(TRY_CAST(coupon_amount AS DECIMAL(18,2)), 0) AS coupon_amount,
    CAST(payable_amount AS DECIMAL(18,2)) AS payable_amount, CAST(order_time AS TIMESTAMP) AS order_time FROM text_order"""
    ),
)
def clean_table(t: Tables):
    return clean.clean_table(text_order(t))


@query(
    "valid_sales_filter",
    "all_orders:i valid_orders:i excluded_orders:i all_details:i valid_details:i excluded_details:i",
    f"""SELECT count(DISTINCT order_id) AS all_orders,
    count(DISTINCT order_id) FILTER (WHERE order_status IN {VALID}) AS valid_orders,
    count(DISTINCT order_id) FILTER (WHERE order_status NOT IN {VALID}) AS excluded_orders,
    count(*) AS all_details, count(*) FILTER (WHERE order_status IN {VALID}) AS valid_details,
    count(*) FILTER (WHERE order_status NOT IN {VALID}) AS excluded_details FROM wide""",
)
def valid_sales_filter(t: Tables):
    return sales.valid_sales_counts(t.clean.order(), t.clean.detail(), t.statuses)


@query(
    "unknown_members",
    "product_id:s product_name:s category_name:s sales_count:i sales_amount:d",
    """SELECT d.product_id, coalesce(p.product_name, '未知商品') AS product_name,
    coalesce(p.category_name, '未知分类') AS category_name, sum(d.quantity) AS sales_count, sum(d.actual_amount) AS sales_amount
    FROM f_detail d LEFT JOIN f_product p ON d.product_id = p.product_id GROUP BY 1, 2, 3""",
)
def unknown_members(t: Tables):
    named = t.faulty.detail().join(
        t.faulty.product().select("product_id", "product_name", "category_name"), "product_id", "left"
    )
    return sales.product_sales_basic(named)


@query(
    "unknown_areas",
    "receiver_province_code:s receiver_province_name:s order_count:i customer_count:i sales_amount:d",
    """SELECT coalesce(c.province_code, 'UNKNOWN') AS receiver_province_code,
    coalesce(c.province_name, '未知地区') AS receiver_province_name, count(*) AS order_count,
    count(DISTINCT o.customer_id) AS customer_count, sum(o.payable_amount) AS sales_amount
    FROM (SELECT DISTINCT * EXCLUDE (receiver_province_code, receiver_province_name) FROM f_order) o
    LEFT JOIN f_customer c ON o.customer_id = c.customer_id GROUP BY 1, 2""",
)
def unknown_areas(t: Tables):
    """Orders of customers nobody knows are kept under the unknown area."""
    home = t.faulty.customer().select(
        "customer_id",
        F.col("province_code").alias("receiver_province_code"),
        F.col("province_name").alias("receiver_province_name"),
    )
    orders = clean.drop_exact_duplicates(t.faulty.order()).drop("receiver_province_code", "receiver_province_name")
    return sales.area_sales(orders.join(home, "customer_id", "left"))


@query(
    "blank_rows",
    "blank_name:i blank_area:i",
    """SELECT count(*) FILTER (WHERE customer_name IS NULL OR trim(customer_name) = '') AS blank_name,
    count(*) FILTER (WHERE province_name IS NULL OR trim(province_name) = '') AS blank_area FROM f_customer""",
)
def blank_rows(t: Tables):
    return t.faulty.customer().agg(
        F.count(F.when(is_blank("customer_name"), 1)).alias("blank_name"),
        F.count(F.when(is_blank("province_name"), 1)).alias("blank_area"),
    )


@query(
    "user_level",
    "customer_id:s total_amount:d user_level:s",
    """SELECT customer_id, total_amount, CASE WHEN total_amount >= 10000 THEN 'VIP'
    WHEN total_amount >= 5000 THEN '重点用户' ELSE '普通用户' END AS user_level FROM users""",
)
def user_level(t: Tables):
    return sales.user_level(sales.user_sales(_valid_orders(t), t.clean.customer()))


@query(
    "channel_projection",
    "order_id:i order_channel:s order_date:y payable_amount:d",
    f"""SELECT order_id, order_channel, order_time AS order_date, payable_amount FROM m_order WHERE order_status IN {VALID}""",
)
def channel_projection(t: Tables):
    return sales.channel_projection(t.clean.order(), t.statuses)
