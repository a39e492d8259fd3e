"""Joins, aggregates, metrics, ranking, segmentation, top-k, star, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.model_sql import VALID, half_up
from checks.registry import Tables, query
from martloom.operators import abc, rank, reconcile, rfm, sales, skew, star, versions, wide
from martloom.plans import warehouse
from martloom.plans.store import LayerStore
from martloom.session import scratch_scope, shuffles_dropped
from martloom.sources.retail import derived_detail

# ---- inputs shared by the queries ----------------------------------------


def all_orders(t: Tables, with_area=False):
    return sales.orders_with_details(t.clean.order(with_area), t.clean.detail())


def valid_orders(t: Tables, with_area=False):
    order = sales.valid_sales(t.clean.order(with_area), t.statuses)
    return sales.orders_with_details(order, t.clean.detail())


def valid_details(t: Tables):
    order = sales.valid_sales(t.clean.order(), t.statuses).select("order_id", "order_time")
    return t.clean.detail().join(order, "order_id")


def wide_table(t: Tables):
    c = t.clean
    return wide.dwd_wide(c.detail_source(), c.order(with_area=True), c.customer(), c.product(), derived_detail)


def users(t: Tables):
    return sales.user_sales(valid_orders(t), t.clean.customer())


def products(t: Tables):
    return sales.product_sales(valid_details(t), t.clean.product())


def daily(t: Tables):
    return sales.daily_sales(valid_orders(t))


def staged_users(t: Tables):
    """The user table as a written layer: later steps read it several times."""
    return t.stage(users(t), "users")


def staged_base(t: Tables):
    return t.stage(rfm.rfm_base(staged_users(t)), "rfm")


def staged_products(t: Tables):
    return t.stage(products(t), "products")


# ---- joins ---------------------------------------------------------------

_WIDE_SHAPE = (
    "order_detail_id:s order_id:i product_id:i quantity:i unit_price:d discount_amount:d actual_amount:d "
    "detail_created_at:t order_no:s customer_id:i order_time:t order_status:s order_amount:d coupon_amount:d "
    "freight_amount:d payable_amount:d order_channel:s receiver_province_code:s receiver_province_name:s "
    "order_updated_at:t customer_name:s member_level:s customer_province_code:s customer_province_name:s "
    "product_name:s category_id:s category_name:s brand_name:s product_standard_price:d cost_price:d"
)


@query("dwd_wide", _WIDE_SHAPE, "SELECT * FROM wide")
def dwd_wide(t: Tables):
    return wide_table(t)


@query(
    "dwd_join_audit",
    "source_rows:i joined_rows:i repeated_rows:i missing_order_rows:i missing_customer_rows:i missing_product_rows:i",
    """WITH o AS (SELECT DISTINCT * FROM f_order), j AS (
      SELECT d.order_detail_id, o.order_id, c.customer_id, p.product_id FROM f_detail d LEFT JOIN o ON d.order_id = o.order_id
      LEFT JOIN f_customer c ON o.customer_id = c.customer_id LEFT JOIN f_product p ON d.product_id = p.product_id)
    SELECT (SELECT count(*) FROM f_detail) AS source_rows, count(*) AS joined_rows,
      count(*) - count(DISTINCT order_detail_id) AS repeated_rows, count(*) - count(order_id) AS missing_order_rows,
      count(*) - count(customer_id) AS missing_customer_rows, count(*) - count(product_id) AS missing_product_rows FROM j""",
)
def dwd_join_audit(t: Tables):
    f = t.faulty
    return wide.dwd_join_audit(f.detail(), f.order().dropDuplicates(), f.customer(), f.product())


@query(
    "dwd_order_driven",
    "order_id:i order_no:s customer_id:i order_time:t order_status:s payable_amount:d customer_name:s member_level:s "
    "order_detail_id:s product_id:d quantity:d actual_amount:d created_at:t product_name:s category_name:s",
    """SELECT o.order_id, o.order_no, o.customer_id, o.order_time, o.order_status, o.payable_amount, c.customer_name, c.member_level,
    d.order_detail_id, d.product_id, d.quantity, d.actual_amount, d.created_at, p.product_name, p.category_name
    FROM m_order o LEFT JOIN m_detail d ON o.order_id = d.order_id LEFT JOIN m_customer c ON o.customer_id = c.customer_id
    LEFT JOIN m_product p ON d.product_id = p.product_id""",
)
def dwd_order_driven(t: Tables):
    c = t.clean
    return wide.dwd_order_driven(c.order(), c.detail(), c.customer(), c.product())


@query(
    "detail_cardinality",
    "multi_detail_orders:i max_details:i",
    """SELECT count(*) FILTER (WHERE n > 1) AS multi_detail_orders, max(n) AS max_details
    FROM (SELECT count(*) AS n FROM m_detail GROUP BY order_id)""",
)
def detail_cardinality(t: Tables):
    return wide.detail_cardinality(t.clean.detail())


@query(
    "join_strategy_equivalence",
    "strategy:s joined_rows:i unmatched_rows:i",
    """WITH j AS (SELECT count(*) AS joined_rows, count(*) - count(p.product_id) AS unmatched_rows
      FROM f_detail d LEFT JOIN f_product p ON d.product_id = p.product_id)
    SELECT 'merge' AS strategy, * FROM j UNION ALL SELECT 'broadcast', * FROM j""",
)
def join_strategy_equivalence(t: Tables):
    return wide.join_strategy_equivalence(t.faulty.detail(), t.faulty.product())


@query(
    "join_row_expansion",
    "order_rows:i order_count:i detail_rows:i detail_order_count:i join_rows:i join_order_count:i",
    """SELECT o.*, d.*, j.* FROM (SELECT count(*) AS order_rows, count(DISTINCT order_id) AS order_count FROM m_order) o,
    (SELECT count(*) AS detail_rows, count(DISTINCT order_id) AS detail_order_count FROM m_detail) d,
    (SELECT count(*) AS join_rows, count(DISTINCT o.order_id) AS join_order_count FROM m_order o JOIN m_detail d ON o.order_id = d.order_id) j""",
)
def join_row_expansion(t: Tables):
    return wide.join_row_expansion(t.clean.order(), t.clean.detail())


@query(
    "amount_duplication",
    "correct_order_amount:d wrong_joined_amount:d repeated_amount:d amplification_ratio:d",
    f"""WITH a AS (SELECT sum(payable_amount) AS correct_order_amount FROM m_order),
    b AS (SELECT sum(o.payable_amount) AS wrong_joined_amount FROM m_order o JOIN m_detail d ON o.order_id = d.order_id)
    SELECT correct_order_amount, wrong_joined_amount, wrong_joined_amount - correct_order_amount AS repeated_amount,
    {half_up("wrong_joined_amount", "correct_order_amount", 4, True, True)} AS amplification_ratio FROM a, b""",
)
def amount_duplication(t: Tables):
    return wide.amount_duplication(t.clean.order(), t.clean.detail())


@query(
    "channel_wrong_vs_correct",
    "order_channel:s order_count:i correct_sales_amount:d wrong_sales_amount:d repeated_amount:d amplification_ratio:d",
    f"""WITH v AS (SELECT * FROM m_order WHERE order_status IN {VALID}),
    w AS (SELECT order_channel, sum(payable_amount) AS wrong_sales_amount FROM v JOIN m_detail d ON v.order_id = d.order_id GROUP BY 1),
    c AS (SELECT order_channel, count(*) AS order_count, sum(payable_amount) AS correct_sales_amount FROM v GROUP BY 1)
    SELECT c.*, wrong_sales_amount, wrong_sales_amount - correct_sales_amount AS repeated_amount,
    {half_up("wrong_sales_amount", "correct_sales_amount", 4, True, True)} AS amplification_ratio
    FROM c JOIN w ON c.order_channel = w.order_channel""",
)
def channel_wrong_vs_correct(t: Tables):
    return wide.channel_wrong_vs_correct(t.clean.order(), t.clean.detail(), t.statuses)


@query(
    "channel_metrics",
    "order_channel:s order_count:i sales_amount:d sales_quantity:i detail_amount:d avg_order_amount:d",
    f"""WITH v AS (SELECT * FROM m_order WHERE order_status IN {VALID}),
    o AS (SELECT order_channel, count(*) AS order_count, sum(payable_amount) AS sales_amount FROM v GROUP BY 1),
    d AS (SELECT order_channel, sum(quantity) AS sales_quantity, sum(actual_amount) AS detail_amount FROM v JOIN m_detail d ON v.order_id = d.order_id GROUP BY 1)
    SELECT o.*, sales_quantity, detail_amount, {half_up("sales_amount", "order_count", 2)} AS avg_order_amount
    FROM o LEFT JOIN d ON o.order_channel = d.order_channel""",
)
def channel_metrics(t: Tables):
    return wide.channel_metrics(t.clean.order(), t.clean.detail(), t.statuses)


# ---- aggregates ----------------------------------------------------------


@query(
    "order_grain",
    "order_id:i customer_id:i order_time:t order_status:s payable_amount:d order_channel:s receiver_province_name:s",
    "SELECT * FROM grain",
)
def order_grain(t: Tables):
    columns = ("order_id", "customer_id", "order_time", "order_status", "payable_amount", "order_channel", "receiver_province_name")
    return sales.order_grain(wide_table(t).select(*columns), columns)


@query(
    "restored_grain_totals",
    "order_count:i restored_order_amount:d detail_count:i",
    """WITH l AS (SELECT o.order_id, max(o.payable_amount) AS p, count(*) AS n FROM m_order o JOIN m_detail d ON o.order_id = d.order_id GROUP BY 1)
    SELECT count(*) AS order_count, sum(p) AS restored_order_amount, sum(n) AS detail_count FROM l""",
)
def restored_grain_totals(t: Tables):
    return wide.restored_grain_totals(t.clean.order(), t.clean.detail())


@query(
    "dws_user_sales",
    "customer_id:i customer_name:s member_level:s customer_province_code:s customer_province_name:s order_count:i "
    "total_amount:d avg_order_amount:d first_order_time:t last_order_time:t",
    "SELECT * FROM users",
)
def dws_user_sales(t: Tables):
    return users(t)


@query(
    "dws_user_sales_basic",
    "customer_id:s customer_name:s order_count:i total_amount:d avg_amount:d first_order_time:t last_order_time:t",
    f"""SELECT o.customer_id, coalesce(c.customer_name, '未知客户') AS customer_name, count(DISTINCT o.order_id) AS order_count,
    sum(payable_amount) AS total_amount, {half_up("sum(payable_amount)", "count(DISTINCT o.order_id)", 2)} AS avg_amount,
    min(order_time) AS first_order_time, max(order_time) AS last_order_time
    FROM (SELECT DISTINCT * FROM f_order) o LEFT JOIN f_customer c ON o.customer_id = c.customer_id
    WHERE order_status IN {VALID} AND o.order_id IN (SELECT order_id FROM f_detail) GROUP BY 1, 2""",
)
def dws_user_sales_basic(t: Tables):
    order = sales.valid_sales(t.faulty.order(), t.statuses).dropDuplicates()
    named = order.join(t.faulty.customer().select("customer_id", "customer_name"), "customer_id", "left")
    return sales.user_sales_basic(sales.orders_with_details(named, t.faulty.detail()))


@query(
    "dws_product_sales",
    "product_id:i product_name:s category_name:s brand_name:s product_standard_price:d cost_price:d sales_order_count:i "
    "sales_detail_count:i sales_count:i sales_amount:d avg_sale_price:d first_sale_time:t last_sale_time:t",
    "SELECT * FROM products",
)
def dws_product_sales(t: Tables):
    return products(t)


@query(
    "dws_product_sales_basic",
    "product_id:s product_name:s category_name:s sales_count:i sales_amount:d",
    "SELECT product_id, product_name, category_name, sales_count, sales_amount FROM products",
)
def dws_product_sales_basic(t: Tables):
    names = t.clean.product().select("product_id", "product_name", "category_name")
    return sales.product_sales_basic(valid_details(t).join(names, "product_id", "left"))


@query(
    "dws_area_sales",
    "receiver_province_code:s receiver_province_name:s order_count:i customer_count:i sales_amount:d avg_order_amount:d "
    "first_order_time:t last_order_time:t",
    "SELECT * FROM area_table",
)
def dws_area_sales(t: Tables):
    return sales.area_sales(valid_orders(t, with_area=True))


@query(
    "area_sales_ordered",
    "receiver_province_name:s order_count:i sales_amount:d",
    "SELECT receiver_province_name, order_count, sales_amount FROM area_table",
)
def area_sales_ordered(t: Tables):
    return sales.area_sales_ordered(valid_orders(t, with_area=True))


_DAILY_SHAPE = (
    "order_date:y year:i month:i year_month:s order_count:i customer_count:i sales_amount:d avg_order_amount:d "
    "coupon_amount:d freight_amount:d"
)


@query("ads_daily_sales", _DAILY_SHAPE, "SELECT * FROM daily")
def ads_daily_sales(t: Tables):
    return daily(t)


@query(
    "ads_daily_sales_basic",
    "order_date:s order_count:i user_count:i sales_amount:d avg_order_amount:d",
    """SELECT strftime(order_date, '%Y-%m-%d') AS order_date, order_count, customer_count AS user_count, sales_amount, avg_order_amount
    FROM daily""",
)
def ads_daily_sales_basic(t: Tables):
    return sales.daily_sales_basic(valid_orders(t))


@query(
    "orders_without_time",
    "invalid_time_orders:i",
    "SELECT count(*) AS invalid_time_orders FROM vgrain WHERE order_time IS NULL",
)
def orders_without_time(t: Tables):
    return sales.orders_without_time(valid_orders(t))


@query(
    "daily_gap_check",
    "first_date:y last_date:y expected_days:i missing_days:i repeated_days:i",
    """SELECT min(order_date) AS first_date, max(order_date) AS last_date, date_diff('day', min(order_date), max(order_date)) + 1 AS expected_days,
    date_diff('day', min(order_date), max(order_date)) + 1 - count(*) AS missing_days, count(*) - count(DISTINCT order_date) AS repeated_days FROM daily""",
)
def daily_gap_check(t: Tables):
    return sales.daily_gap_check(daily(t))


@query(
    "monthly_base",
    "year_month:s year:i month:i sales_days:i order_count:i sales_amount:d avg_order_amount:d coupon_amount:d freight_amount:d",
    "SELECT * FROM monthly",
)
def monthly_base(t: Tables):
    return sales.monthly_base(daily(t))


@query(
    "channel_summary",
    "order_channel:s order_count:i sales_amount:d",
    "SELECT order_channel, count(*) AS order_count, sum(payable_amount) AS sales_amount FROM vgrain GROUP BY 1",
)
def channel_summary(t: Tables):
    return sales.channel_summary(valid_orders(t))


_STATUS = """by_status AS (SELECT g.order_status, count(*) AS order_count, sum(g.payable_amount) AS sales_amount FROM grain g GROUP BY 1),
sold AS (SELECT order_status, count(*) AS detail_count, sum(quantity) AS sales_quantity, sum(actual_amount) AS detail_amount FROM wide GROUP BY 1)"""


@query(
    "status_summary",
    "order_status:s order_count:i sales_amount:d order_rate:d detail_count:i sales_quantity:i detail_amount:d",
    f"""WITH {_STATUS} SELECT b.order_status, order_count, sales_amount,
    {half_up("(order_count * 100)", "(SELECT sum(order_count) FROM by_status)", 2, False)} AS order_rate, detail_count, sales_quantity, detail_amount
    FROM by_status b JOIN sold s ON b.order_status IS NOT DISTINCT FROM s.order_status""",
)
def status_summary(t: Tables):
    return sales.status_summary(t.clean.order(), t.clean.detail())


@query(
    "status_totals",
    "all_orders:i all_amount:d valid_orders:i valid_amount:d excluded_orders:i excluded_amount:d valid_details:i valid_quantity:i valid_detail_amount:d",
    f"""WITH {_STATUS} SELECT sum(order_count) AS all_orders, sum(sales_amount) AS all_amount,
    sum(order_count) FILTER (WHERE order_status IN {VALID}) AS valid_orders, sum(sales_amount) FILTER (WHERE order_status IN {VALID}) AS valid_amount,
    sum(order_count) FILTER (WHERE order_status NOT IN {VALID}) AS excluded_orders, sum(sales_amount) FILTER (WHERE order_status NOT IN {VALID}) AS excluded_amount,
    (SELECT sum(detail_count) FROM sold WHERE order_status IN {VALID}) AS valid_details,
    (SELECT sum(sales_quantity) FROM sold WHERE order_status IN {VALID}) AS valid_quantity,
    (SELECT sum(detail_amount) FROM sold WHERE order_status IN {VALID}) AS valid_detail_amount FROM by_status""",
)
def status_totals(t: Tables):
    return sales.status_totals(sales.status_summary(t.clean.order(), t.clean.detail()), t.statuses)


def _grain_sql(table: str, key: str) -> str:
    return f"SELECT count(*) AS total_rows, count(DISTINCT {key}) AS distinct_keys, count(*) - count(DISTINCT {key}) AS duplicate_rows FROM {table}"


_GRAIN = "total_rows:i distinct_keys:i duplicate_rows:i"


@query("orders_grain_audit", _GRAIN, _grain_sql("f_order", "order_id"))
def orders_grain_audit(t: Tables):
    return sales.grain_audit(t.faulty.order(), "order_id")


@query(
    "detail_grain_audit",
    _GRAIN + " distinct_orders:i avg_details_per_order:d",
    f"""SELECT count(*) AS total_rows, count(DISTINCT order_detail_id) AS distinct_keys, count(*) - count(DISTINCT order_detail_id) AS duplicate_rows,
    count(DISTINCT order_id) AS distinct_orders, {half_up("count(*)", "count(DISTINCT order_id)", 2, False)} AS avg_details_per_order FROM m_detail""",
)
def detail_grain_audit(t: Tables):
    return sales.detail_grain_audit(t.clean.detail())


@query("customer_grain_audit", _GRAIN, _grain_sql("m_customer", "customer_id"))
def customer_grain_audit(t: Tables):
    return sales.grain_audit(t.clean.customer(), "customer_id")


@query("product_grain_audit", _GRAIN, _grain_sql("m_product", "product_id"))
def product_grain_audit(t: Tables):
    return sales.grain_audit(t.clean.product(), "product_id")


@query(
    "bucket_totals",
    "bucket:i row_count:i id_sum:i id_avg:d",
    "SELECT order_id % 4 AS bucket, count(*) AS row_count, sum(order_id) AS id_sum, avg(order_id) AS id_avg FROM m_order GROUP BY 1",
)
def bucket_totals(t: Tables):
    return sales.id_bucket_totals(t.clean.order(), "order_id")


_SALT = "SELECT product_id, count(*) AS row_count, sum(actual_amount) AS total_amount FROM f_detail GROUP BY 1"


@query("salted_aggregate", "product_id:s row_count:i total_amount:d", _SALT)
def salted_aggregate(t: Tables):
    return skew.salted_aggregate(t.faulty.detail(), "product_id", "actual_amount", "order_detail_id")


def _skew_sql(column: str) -> str:
    return f"""SELECT '{column}' AS column_name, (SELECT count(*) FROM wide WHERE {column} IS NULL) AS null_count, count(*) AS key_count,
    sum(n) AS total_rows, max(n) AS max_rows, {half_up("sum(n)", "count(*)", 2, False)} AS avg_rows,
    {half_up("(max(n) * count(*))", "sum(n)", 2, False)} AS skew_ratio,
    CASE WHEN max(n) * count(*) >= sum(n) * 10 THEN 'hot' WHEN max(n) * count(*) >= sum(n) * 5 THEN 'watch' ELSE 'even' END AS verdict
    FROM (SELECT {column}, count(*) AS n FROM wide WHERE {column} IS NOT NULL GROUP BY 1)"""


_SKEW_COLUMNS = ("customer_id", "product_id", "receiver_province_name", "order_channel")


@query(
    "key_skew_audit",
    "column_name:s null_count:i key_count:i total_rows:i max_rows:i avg_rows:d skew_ratio:d verdict:s",
    " UNION ALL ".join(_skew_sql(c) for c in _SKEW_COLUMNS),
)
def key_skew_audit(t: Tables):
    order = t.clean.order(with_area=True).select("order_id", "customer_id", "receiver_province_name", "order_channel")
    rows = t.clean.detail().select("order_id", "product_id").join(order, "order_id", "left")
    return skew.key_skew_audit(rows, list(_SKEW_COLUMNS))


@query(
    "top_keys",
    "product_id:i row_count:i",
    "SELECT product_id, count(*) AS row_count FROM m_detail GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def top_keys(t: Tables):
    return skew.top_keys(t.clean.detail(), "product_id")


@query(
    "event_skew_audit",
    "column_name:s null_count:i key_count:i total_rows:i max_rows:i verdict:s",
    """SELECT 'user_id' AS column_name, (SELECT count(*) FROM events WHERE user_id IS NULL) AS null_count, count(*) AS key_count,
    sum(n) AS total_rows, max(n) AS max_rows,
    CASE WHEN max(n) * count(*) >= sum(n) * 10 THEN 'hot' WHEN max(n) * count(*) >= sum(n) * 5 THEN 'watch' ELSE 'even' END AS verdict
    FROM (SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1)""",
)
def event_skew_audit(t: Tables):
    return skew.key_skew_audit(t.clean.raw("events"), "user_id")


@query(
    "partition_balance",
    "layout:s total_rows:i fits:b",
    """SELECT 'as read' AS layout, count(*) AS total_rows, true AS fits FROM events
    UNION ALL SELECT 'repartitioned', count(*), true FROM events UNION ALL SELECT 'coalesced', count(*), true FROM events""",
)
def partition_balance(t: Tables):
    limit = F.when(F.col("layout") == "coalesced", 2).when(F.col("layout") == "repartitioned", 8)
    return skew.partition_balance(t.clean.raw("events"), "user_id").withColumn(
        "fits", F.coalesce(F.col("partitions_used") <= limit, F.lit(True))
    )


# ---- windows, ranking, segmentation --------------------------------------


@query(
    "monthly_trend",
    "year_month:s year:i month:i sales_days:i order_count:i sales_amount:d avg_order_amount:d coupon_amount:d freight_amount:d "
    "previous_month_order_count:d previous_month_sales_amount:d order_count_mom_rate:d sales_amount_mom_rate:d "
    "cumulative_order_count:i cumulative_sales_amount:d",
    "SELECT * FROM trend",
)
def monthly_trend(t: Tables):
    return sales.monthly_trend(sales.monthly_base(daily(t)))


@query(
    "global_rank",
    "order_id:i rn:i running:d n:i",
    """SELECT order_id, row_number() OVER (ORDER BY payable_amount DESC, order_id) AS rn,
    sum(payable_amount) OVER (ORDER BY payable_amount DESC, order_id ROWS UNBOUNDED PRECEDING) AS running, count(*) OVER () AS n FROM m_order""",
)
def global_rank(t: Tables):
    order = t.clean.order().select("order_id", "payable_amount")
    return rank.global_rank(
        order, [F.desc("payable_amount"), F.asc("order_id")], running={"running": "payable_amount"}, total="n"
    )


@query(
    "rfm_base",
    "customer_id:i customer_name:s member_level:s first_order_time:t last_order_time:t recency_days:i frequency:i monetary:d rfm_reference_date:y",
    "SELECT * FROM rfm",
)
def rfm_base(t: Tables):
    return rfm.rfm_base(staged_users(t))


@query(
    "rfm_base_checks",
    "source_users:i source_amount:d rfm_users:i duplicate_users:i rfm_amount:d invalid_recency:i invalid_frequency:i invalid_monetary:i non_positive_monetary:i",
    """SELECT (SELECT count(*) FROM users) AS source_users, (SELECT sum(total_amount) FROM users) AS source_amount, count(*) AS rfm_users,
    count(*) - count(DISTINCT customer_id) AS duplicate_users, sum(monetary) AS rfm_amount, count(*) FILTER (WHERE recency_days < 0) AS invalid_recency,
    count(*) FILTER (WHERE frequency <= 0) AS invalid_frequency, count(*) FILTER (WHERE monetary < 0) AS invalid_monetary,
    count(*) FILTER (WHERE monetary <= 0) AS non_positive_monetary FROM rfm""",
)
def rfm_base_checks(t: Tables):
    source = staged_users(t)
    return rfm.rfm_base_checks(source, rfm.rfm_base(source))


@query(
    "rfm_scores_ntile",
    "customer_id:i recency_days:i frequency:i monetary:d r_score:i f_score:i m_score:i rfm_total_score:i",
    "SELECT * FROM ntile_scores",
)
def rfm_scores_ntile(t: Tables):
    return rfm.scores_by_ntile(rfm.rfm_base(staged_users(t)))


@query(
    "rfm_scores_percentile",
    "customer_id:i recency_days:i frequency:i monetary:d r_score:i f_score:i m_score:i rfm_score:i rfm_code:s",
    "SELECT * FROM percent_scores",
)
def rfm_scores_percentile(t: Tables):
    return rfm.scores_by_percentile(staged_base(t))


def segmented(t: Tables):
    return rfm.segments(rfm.scores_by_ntile(rfm.rfm_base(staged_users(t))))


@query(
    "rfm_segments",
    "customer_id:i r_score:i f_score:i m_score:i user_segment:s",
    "SELECT * FROM segmented",
)
def rfm_segments(t: Tables):
    return segmented(t)


@query(
    "rfm_segments_percentile",
    "customer_id:i rfm_code:s user_segment:s",
    "SELECT * FROM psegmented",
)
def rfm_segments_percentile(t: Tables):
    return rfm.segments(rfm.scores_by_percentile(staged_base(t)))


@query(
    "rfm_segment_summary",
    "user_segment:s user_count:i user_rate:d user_percent:d avg_recency:d avg_frequency:d total_monetary:d avg_monetary:d avg_r_score:d avg_f_score:d avg_m_score:d",
    "SELECT * FROM segment_table",
)
def rfm_segment_summary(t: Tables):
    return rfm.segment_summary(segmented(t))


@query(
    "rfm_segment_checks",
    "base_users:i base_amount:d segment_users:i distinct_users:i segment_amount:d invalid_scores:i invalid_total_scores:i unclassified_users:i summary_users:i summary_amount:d segments:i",
    """SELECT (SELECT count(*) FROM rfm) AS base_users, (SELECT sum(monetary) FROM rfm) AS base_amount, count(*) AS segment_users,
    count(DISTINCT customer_id) AS distinct_users, sum(monetary) AS segment_amount,
    count(*) FILTER (WHERE NOT (r_score BETWEEN 1 AND 5 AND f_score BETWEEN 1 AND 5 AND m_score BETWEEN 1 AND 5)) AS invalid_scores,
    count(*) FILTER (WHERE rfm_total_score NOT BETWEEN 3 AND 15) AS invalid_total_scores, count(*) FILTER (WHERE user_segment = '未分类') AS unclassified_users,
    (SELECT sum(user_count) FROM segment_table) AS summary_users, (SELECT sum(total_monetary) FROM segment_table) AS summary_amount,
    (SELECT count(*) FROM segment_table) AS segments FROM segmented""",
)
def rfm_segment_checks(t: Tables):
    base = staged_base(t)
    done = t.stage(rfm.segments(rfm.scores_by_ntile(base)), "segments")
    return rfm.segment_checks(base, done, rfm.segment_summary(done), "rfm_total_score")


@query(
    "product_ranking_abc",
    "product_id:i product_name:s sales_count:i sales_amount:d sales_amount_rank:i sales_amount_rate:d cumulative_sales_amount:d cumulative_sales_amount_rate:d abc_level:s",
    "SELECT * FROM ranked",
)
def product_ranking_abc(t: Tables):
    return abc.product_ranking(products(t))


@query(
    "abc_summary",
    "abc_level:s product_count:i sales_count:i sales_amount:d sales_amount_rate:d",
    "SELECT * FROM abc_table",
)
def abc_summary(t: Tables):
    return abc.abc_summary(abc.product_ranking(products(t)))


@query(
    "product_abc_checks",
    "source_products:i source_distinct:i source_amount:d ranked_products:i ranked_distinct:i distinct_ranks:i min_rank:i max_rank:i ranked_amount:d last_cumulative_amount:d last_cumulative_rate:d invalid_levels:i summary_products:i summary_amount:d levels:i",
    """SELECT (SELECT count(*) FROM products) AS source_products, (SELECT count(DISTINCT product_id) FROM products) AS source_distinct,
    (SELECT sum(sales_amount) FROM products) AS source_amount, count(*) AS ranked_products, count(DISTINCT product_id) AS ranked_distinct,
    count(DISTINCT sales_amount_rank) AS distinct_ranks, min(sales_amount_rank) AS min_rank, max(sales_amount_rank) AS max_rank,
    sum(sales_amount) AS ranked_amount, max(cumulative_sales_amount) AS last_cumulative_amount, max(cumulative_sales_amount_rate) AS last_cumulative_rate,
    count(*) FILTER (WHERE abc_level NOT IN ('A类', 'B类', 'C类')) AS invalid_levels, (SELECT sum(product_count) FROM abc_table) AS summary_products,
    (SELECT sum(sales_amount) FROM abc_table) AS summary_amount, (SELECT count(*) FROM abc_table) AS levels FROM ranked""",
)
def product_abc_checks(t: Tables):
    source = staged_products(t)
    done = t.stage(abc.product_ranking(source), "ranked")
    return abc.abc_checks(source, done, abc.abc_summary(done))


@query(
    "product_dense_ranks",
    "product_id:i sales_count:i sales_amount:d sales_count_rank:i sales_amount_rank:i",
    """SELECT product_id, sales_count, sales_amount, dense_rank() OVER (ORDER BY sales_count DESC) AS sales_count_rank,
    dense_rank() OVER (ORDER BY sales_amount DESC) AS sales_amount_rank FROM products""",
)
def product_dense_ranks(t: Tables):
    return abc.product_dense_ranks(staged_products(t))


def _versions(t: Tables):
    """Details of one state as originals; returned lines as corrections."""
    keep = ("order_detail_id", "order_id", "quantity", "actual_amount")
    base = versions.versioned(
        t.clean.detail().select(*keep), versions.ORIGINAL, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    )
    fixed_up = t.clean.detail().filter(F.col("quantity") >= 40).select(*keep)
    delta = versions.versioned(
        fixed_up.withColumn("actual_amount", (F.col("actual_amount") + 1).cast("decimal(18,2)")),
        versions.CORRECTED,
        F.lit("2025-02-01 00:00:00").cast("timestamp_ntz"),
    )
    return base, delta


@query(
    "latest_version",
    "order_detail_id:s order_id:i quantity:i actual_amount:d record_update_time:t record_source:s",
    """WITH v AS (SELECT order_detail_id, order_id, quantity, actual_amount, TIMESTAMP '2025-01-01 00:00:00' AS record_update_time, 'ORIGINAL' AS record_source FROM m_detail
      UNION ALL SELECT order_detail_id, order_id, quantity, actual_amount + 1, TIMESTAMP '2025-02-01 00:00:00', 'CORRECTED' FROM m_detail WHERE quantity >= 40)
    SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY order_detail_id ORDER BY record_update_time DESC, record_source DESC) = 1""",
)
def latest_version(t: Tables):
    return versions.latest_version(*_versions(t), "order_detail_id")


@query(
    "latest_version_checks",
    "base_rows:i delta_rows:i combined_rows:i repeated_keys:i merged_rows:i corrected_kept:i",
    """SELECT count(*) AS base_rows, count(*) FILTER (WHERE quantity >= 40) AS delta_rows, count(*) + count(*) FILTER (WHERE quantity >= 40) AS combined_rows,
    count(*) FILTER (WHERE quantity >= 40) AS repeated_keys, count(*) AS merged_rows, count(*) FILTER (WHERE quantity >= 40) AS corrected_kept FROM m_detail""",
)
def latest_version_checks(t: Tables):
    return versions.merge_checks(*_versions(t), "order_detail_id")


# ---- top-k ---------------------------------------------------------------


@query(
    "top_orders_by_details",
    "order_id:i payable_amount:d detail_count:i total_quantity:i detail_amount:d",
    """SELECT o.order_id, o.payable_amount, count(*) AS detail_count, sum(d.quantity) AS total_quantity, sum(d.actual_amount) AS detail_amount
    FROM m_order o JOIN m_detail d ON o.order_id = d.order_id GROUP BY 1, 2 ORDER BY detail_count DESC, o.order_id LIMIT 10""",
)
def top_orders_by_details(t: Tables):
    return wide.top_orders_by_details(t.clean.order(), t.clean.detail())


@query(
    "top_users",
    "customer_id:i customer_name:s order_count:i total_amount:d",
    "SELECT * FROM users ORDER BY total_amount DESC, customer_id LIMIT 10",
)
def top_users(t: Tables):
    return sales.top_n(users(t), "total_amount", "customer_id", 10)


@query(
    "top_products",
    "product_id:i product_name:s sales_count:i sales_amount:d",
    "SELECT * FROM products ORDER BY sales_amount DESC, product_id LIMIT 20",
)
def top_products(t: Tables):
    return sales.top_n(products(t), "sales_amount", "product_id", 20)


@query(
    "top_areas",
    "receiver_province_code:s receiver_province_name:s sales_amount:d",
    "SELECT * FROM area_table ORDER BY sales_amount DESC, receiver_province_code LIMIT 10",
)
def top_areas(t: Tables):
    return sales.top_n(sales.area_sales(valid_orders(t, with_area=True)), "sales_amount", "receiver_province_code", 10)


@query(
    "top_segment_users",
    "customer_id:i monetary:d user_segment:s",
    "SELECT * FROM segmented WHERE user_segment = '重要价值用户' ORDER BY monetary DESC, customer_id LIMIT 10",
)
def top_segment_users(t: Tables):
    return rfm.top_segment_users(segmented(t), "重要价值用户")


@query(
    "first_n_by_key",
    "order_detail_id:s actual_amount:d",
    "SELECT order_detail_id, actual_amount FROM m_detail ORDER BY order_detail_id LIMIT 100",
)
def first_n_by_key(t: Tables):
    return sales.first_n(t.clean.detail(), "order_detail_id", 100)


@query(
    "distinct_set_equality",
    "found:s ok:b",
    """SELECT string_agg(l, ',' ORDER BY l) AS found, string_agg(l, ',' ORDER BY l) = 'A,B,C' AS ok
    FROM (SELECT DISTINCT substring(abc_level, 1, 1) AS l FROM ranked)""",
)
def distinct_set_equality(t: Tables):
    return reconcile.distinct_set_equality(abc.product_ranking(products(t)), "abc_level")


# ---- star schema ---------------------------------------------------------

_FACT_SQL = f"""SELECT order_id, order_no, customer_id, order_time, order_status, order_amount, coupon_amount, freight_amount, payable_amount,
    order_channel, receiver_province_code, receiver_province_name, order_time AS order_date, order_status IN {VALID} AS is_valid_sale FROM grain"""


def fact(t: Tables):
    c = t.clean
    d = c.detail().select("order_id").join(c.order(with_area=True), "order_id", "left")
    return star.fact_order(d, t.statuses)


@query(
    "fact_order",
    "order_id:i order_no:s customer_id:i order_time:t order_status:s order_amount:d coupon_amount:d freight_amount:d "
    "payable_amount:d order_channel:s receiver_province_code:s receiver_province_name:s order_date:y is_valid_sale:b",
    _FACT_SQL,
)
def fact_order(t: Tables):
    return fact(t)


@query(
    "fact_order_detail",
    "order_detail_id:s order_id:i product_id:i quantity:i unit_price:d discount_amount:d actual_amount:d created_at:t",
    "SELECT * FROM m_detail",
)
def fact_order_detail(t: Tables):
    return star.fact_order_detail(t.clean.detail())


@query(
    "dim_customer",
    "customer_id:s customer_name:s member_level:s province_code:s province_name:s",
    "SELECT * FROM f_customer",
)
def dim_customer(t: Tables):
    doubled = t.faulty.customer().unionByName(t.faulty.customer())
    return star.dim_customer(doubled)


@query(
    "dim_product",
    "product_id:s product_name:s category_name:s brand_name:s cost_price:d",
    "SELECT * FROM f_product",
)
def dim_product(t: Tables):
    doubled = t.faulty.product().unionByName(t.faulty.product())
    return star.dim_product(doubled)


_CONFLICT = """SELECT {key}, 2 AS versions FROM {table} WHERE {name} IS NOT NULL AND CAST({key} AS BIGINT) % 7 = 0"""


@query("customer_conflicts", "customer_id:s versions:i", _CONFLICT.format(key="customer_id", table="f_customer", name="customer_name"))
def customer_conflicts(t: Tables):
    """Copies of some customers have lost their name."""
    customer = t.faulty.customer()
    nameless = customer.where(F.col("customer_id").cast("bigint") % 7 == 0).withColumn("customer_name", F.lit(None).cast("string"))
    return star.customer_conflicts(customer.unionByName(customer).unionByName(nameless))


@query("product_conflicts", "product_id:s versions:i", _CONFLICT.format(key="product_id", table="f_product", name="category_name"))
def product_conflicts(t: Tables):
    product = t.faulty.product()
    lost = product.where(F.col("product_id").cast("bigint") % 7 == 0).withColumn("category_name", F.lit(None).cast("string"))
    return star.product_conflicts(product.unionByName(product).unionByName(lost))


@query(
    "dim_date",
    "date:y year:i quarter:s month:i year_month:s day:i week_of_year:i weekday_number:i weekday_name:s is_weekend:b",
    """WITH span AS (SELECT CAST(min(order_time) AS DATE) AS a, CAST(max(order_time) AS DATE) AS b FROM grain),
    days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span)
    SELECT date, year(date) AS year, 'Q' || quarter(date) AS quarter, month(date) AS month, strftime(date, '%Y-%m') AS year_month,
    day(date) AS day, weekofyear(date) AS week_of_year, isodow(date) AS weekday_number,
    ['星期一', '星期二', '星期三', '星期四', '星期五', '星期六', '星期日'][isodow(date)] AS weekday_name, isodow(date) >= 6 AS is_weekend FROM days""",
)
def dim_date(t: Tables):
    return star.dim_date(fact(t))


@query(
    "star_integrity",
    "check_name:s errors:i",
    """SELECT 'customer_key_repeated' AS check_name, count(*) FILTER (WHERE CAST(customer_id AS BIGINT) % 11 = 0) AS errors FROM f_customer
    UNION ALL SELECT 'product_key_repeated', count(*) FILTER (WHERE CAST(product_id AS BIGINT) % 13 = 0) FROM f_product
    UNION ALL SELECT 'date_key_repeated', count(*) - count(DISTINCT d) FROM (SELECT CAST(order_time AS DATE) AS d FROM m_order GROUP BY 1)
    UNION ALL SELECT 'order_without_customer', count(*) FROM (SELECT DISTINCT order_id, customer_id FROM f_order) WHERE customer_id NOT IN (SELECT customer_id FROM f_customer)
    UNION ALL SELECT 'detail_without_product', count(*) FROM f_detail WHERE product_id NOT IN (SELECT product_id FROM f_product)
    UNION ALL SELECT 'order_without_date', count(*) FROM (SELECT DISTINCT order_id, order_time FROM f_order) WHERE day(order_time) = 31""",
)
def star_integrity(t: Tables):
    """Typed tables with some members twice, and a calendar without the 31st."""
    f = t.faulty
    orders = f.order().dropDuplicates().withColumn("order_date", F.to_date("order_time"))
    customer, product = f.customer(), f.product()
    customers = customer.unionByName(customer.where(F.col("customer_id").cast("bigint") % 11 == 0))
    products = product.unionByName(product.where(F.col("product_id").cast("bigint") % 13 == 0))
    return star.star_integrity(orders, f.detail(), customers, products, star.dim_date(orders).where("day < 31"))


# ---- reconciliation ------------------------------------------------------

_CHECK = "check_name:s source_value:d target_value:d difference:d passed:b"


def _checks_sql(rows) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS check_name, s AS source_value, t AS target_value, abs(s - t) AS difference, abs(s - t) <= {tol} AS passed "
        f"FROM (SELECT coalesce({s}, 0) AS s, coalesce({g}, 0) AS t)"
        for n, s, g, tol in rows
    )


def _one(expr: str, table: str) -> str:
    return f"(SELECT {expr} FROM {table})"


O_N, O_A = _one("count(*)", "vgrain"), _one("sum(payable_amount)", "vgrain")
U_N, U_O, U_A = _one("count(*)", "users"), _one("sum(order_count)", "users"), _one("sum(total_amount)", "users")
D_N, D_O, D_A = _one("count(*)", "daily"), _one("sum(order_count)", "daily"), _one("sum(sales_amount)", "daily")
M_O, M_A = _one("sum(order_count)", "monthly"), _one("sum(sales_amount)", "monthly")
A_O, A_A = _one("sum(order_count)", "area_table"), _one("sum(sales_amount)", "area_table")
W_N, W_Q, W_A = _one("count(*)", "vwide"), _one("sum(quantity)", "vwide"), _one("sum(actual_amount)", "vwide")
P_N, P_Q, P_A = _one("count(*)", "products"), _one("sum(sales_count)", "products"), _one("sum(sales_amount)", "products")
_V = f"m_order WHERE order_status IN {VALID}"
V_N, V_A, V_U = _one("count(*)", _V), _one("sum(payable_amount)", _V), _one("count(DISTINCT customer_id)", _V)
R_N, R_Q, R_A = _one("count(*)", "ranked"), _one("sum(sales_count)", "ranked"), _one("sum(sales_amount)", "ranked")


@query("compare_metric", _CHECK, _checks_sql([("sales", O_A, D_A, 0.01)]))
def compare_metric(t: Tables):
    orders = valid_orders(t)
    return reconcile.compare_metric("sales", orders, "payable_amount", sales.daily_sales(orders), "sales_amount", "0.01")


@query(
    "user_sales_checks",
    _CHECK,
    _checks_sql([("user_orders", O_N, U_O, 0), ("user_amount", O_A, U_A, 0.01), ("user_repeated", "0", "0", 0)]),
)
def user_sales_checks(t: Tables):
    orders = t.stage(valid_orders(t), "orders")
    return reconcile.user_sales_checks(orders, t.stage(sales.user_sales(orders, t.clean.customer()), "users"))


@query(
    "product_sales_checks",
    _CHECK,
    _checks_sql(
        [
            ("product_details", W_N, "(SELECT sum(sales_detail_count) FROM products)", 0),
            ("product_quantity", W_Q, P_Q, 0),
            ("product_amount", W_A, P_A, 0.01),
            ("product_repeated", "0", "0", 0),
        ]
    ),
)
def product_sales_checks(t: Tables):
    details = valid_details(t)
    return reconcile.product_sales_checks(details, t.stage(sales.product_sales(details, t.clean.product()), "products"))


@query("area_sales_checks", _CHECK, _checks_sql([("area_orders", O_N, A_O, 0), ("area_amount", O_A, A_A, 0.01)]))
def area_sales_checks(t: Tables):
    return reconcile.area_sales_checks(valid_orders(t), sales.area_sales(valid_orders(t, with_area=True)))


@query("daily_sales_checks", _CHECK, _checks_sql([("daily_orders", O_N, D_O, 0), ("daily_amount", O_A, D_A, 0.01)]))
def daily_sales_checks(t: Tables):
    orders = valid_orders(t)
    return reconcile.daily_sales_checks(orders, sales.daily_sales(orders))


@query(
    "monthly_checks",
    _CHECK,
    _checks_sql(
        [
            ("monthly_orders", D_O, M_O, 0),
            ("monthly_amount", D_A, M_A, 0.01),
            ("monthly_repeated", "0", "0", 0),
            ("last_running_orders", M_O, "(SELECT max(cumulative_order_count) FROM trend)", 0),
            ("last_running_amount", M_A, "(SELECT max(cumulative_sales_amount) FROM trend)", 0.01),
        ]
    ),
)
def monthly_checks(t: Tables):
    days = t.stage(daily(t), "daily")
    return reconcile.monthly_checks(days, t.stage(sales.monthly_trend(sales.monthly_base(days)), "trend"))


def built(t: Tables, build, check):
    """Check rows of a warehouse as the plan builds it. They are written; the warehouse itself goes."""
    with scratch_scope(t.spark) as keep, shuffles_dropped(t.spark):
        return keep(check(build(t.clean, LayerStore(t.spark, t.scratch("warehouse")))), "checks")


@query(
    "warehouse_checks_29",
    _CHECK,
    _checks_sql(
        list(
            zip(
                reconcile.CHECKS_29,
                [
                    _one("count(*)", "m_order"), _one("count(*)", "m_detail"), _one("count(DISTINCT customer_id)", "vgrain"), O_N, O_A,
                    O_N, O_A, _one("count(DISTINCT CAST(order_time AS DATE))", "vgrain"), O_N, O_A, O_N, O_A, U_N, _one("count(*)", "rfm"), U_A,
                    _one("sum(monetary)", "rfm"), _one("count(DISTINCT product_id)", "vwide"), W_Q, W_A, P_N, P_Q, P_A, "1", R_N, R_N, "1", "3", R_N, R_A,
                ],
                [
                    _one("count(DISTINCT order_id)", "wide"), _one("count(*)", "wide"), U_N, U_O, U_A, A_O, A_A, D_N, D_O, D_A, M_O, M_A,
                    _one("count(*)", "rfm"), _one("count(*)", "segmented"), _one("sum(monetary)", "rfm"), _one("sum(monetary)", "segmented"),
                    P_N, P_Q, P_A, R_N, R_Q, R_A, _one("min(sales_amount_rank)", "ranked"), _one("max(sales_amount_rank)", "ranked"),
                    _one("count(DISTINCT sales_amount_rank)", "ranked"), _one("max(cumulative_sales_amount_rate)", "ranked"),
                    _one("count(DISTINCT abc_level)", "ranked"), _one("sum(product_count)", "abc_table"), _one("sum(sales_amount)", "abc_table"),
                ],
                [0, 0, 0, 0, 0.01, 0, 0.01, 0, 0, 0.01, 0, 0.01, 0, 0, 0.01, 0.01, 0, 0, 0.01, 0, 0, 0.01, 0, 0, 0, 0.0001, 0, 0, 0.01],
            )
        )
    ),
)
def warehouse_checks_29(t: Tables):
    return built(t, warehouse.detail_warehouse, lambda found: reconcile.warehouse_checks_29(found, t.statuses))


@query(
    "warehouse_checks_12",
    _CHECK,
    _checks_sql(
        list(
            zip(
                reconcile.CHECKS_12,
                [V_N, V_A, V_N, V_A, V_U, V_N, V_A, W_Q, W_A, P_N, P_Q, P_A],
                [V_N, V_A, V_N, V_A, V_U, V_N, V_A, P_Q, P_A, P_N, P_Q, P_A],
                [0, 0.01, 0, 0.01, 0, 0, 0.01, 0, 0.01, 0, 0, 0.01],
            )
        )
    ),
)
def warehouse_checks_12(t: Tables):
    """The order-driven warehouse. Orders without any detail are sold orders here."""
    return built(t, warehouse.order_warehouse, lambda found: reconcile.warehouse_checks_12(found, t.statuses))


@query(
    "layer_row_parity",
    _CHECK,
    _checks_sql(
        [
            (reconcile.PARITY_PAIRS[0][0], _one("count(*)", "wide"), _one("count(*)", "m_detail"), 0),
            (reconcile.PARITY_PAIRS[1][0], U_N, _one("count(*)", "segmented"), 0),
            (reconcile.PARITY_PAIRS[2][0], P_N, R_N, 0),
            (
                reconcile.PARITY_PAIRS[3][0],
                D_N,
                "(SELECT date_diff('day', CAST(min(order_time) AS DATE), CAST(max(order_time) AS DATE)) + 1 FROM grain)",
                0,
            ),
        ]
    ),
)
def layer_row_parity(t: Tables):
    return built(t, warehouse.detail_warehouse, reconcile.layer_row_parity)
