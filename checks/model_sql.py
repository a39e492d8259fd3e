"""The warehouse tables as SQL common table expressions.

The same mapping and definitions as the Spark side, written independently in
plain SQL: windows without partitioning, joins before aggregates, distinct
counts, so that an error in a scaled rewrite shows as a difference.
"""

from __future__ import annotations


def half_up(num: str, den: str, scale: int, num_money: bool = True, den_money: bool = False) -> str:
    """SQL for num / den rounded half away from zero, in whole numbers."""
    n = f"CAST(abs({num}) * 100 AS HUGEINT)" if num_money else f"CAST(abs({num}) AS HUGEINT)"
    d = f"CAST(abs({den}) * 100 AS HUGEINT)" if den_money else f"CAST(abs({den}) AS HUGEINT)"
    if num_money and not den_money:
        d = f"({d} * 100)"
    q = f"(({n} * {2 * 10**scale} + {d}) // (2 * {d}))"
    sign = f"(CASE WHEN ({num} < 0) <> ({den} < 0) THEN -1 ELSE 1 END)"
    return f"(CASE WHEN {den} <> 0 THEN {sign} * CAST({q} AS DOUBLE) / {10**scale} END)"


VALID = "('O', 'F')"

_HIGH = {
    "重要价值用户": (1, 1, 1),
    "重要保持用户": (0, 1, 1),
    "重要发展用户": (1, 0, 1),
    "重要挽留用户": (0, 0, 1),
    "一般价值用户": (1, 1, 0),
    "一般保持用户": (0, 1, 0),
    "一般发展用户": (1, 0, 0),
    "一般挽留用户": (0, 0, 0),
}


def segment_case() -> str:
    arms = []
    for name, flags in _HIGH.items():
        test = " AND ".join(f"{c}_score {'>=' if f else '<'} 4" for c, f in zip("rfm", flags))
        arms.append(f"WHEN {test} THEN '{name}'")
    return "CASE " + " ".join(arms) + " ELSE '未分类' END"


MODEL = f"""WITH
areas AS (SELECT n_nationkey, n_name FROM nation),
m_order AS (
  SELECT o_orderkey AS order_id, 'NO' || o_orderkey AS order_no, o_custkey AS customer_id,
    CAST(NULL AS VARCHAR) AS shop_id, o_orderdate AS order_time, o_orderstatus AS order_status,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) + (o_orderkey % 3) * 10 - (o_orderkey % 4) * 4 AS DECIMAL(18,2)) AS order_amount,
    CAST((o_orderkey % 3) * 10 AS DECIMAL(18,2)) AS coupon_amount,
    CAST((o_orderkey % 4) * 4 AS DECIMAL(18,2)) AS freight_amount,
    CAST(o_totalprice AS DECIMAL(18,2)) AS payable_amount,
    o_orderpriority AS order_channel,
    CAST(c_nationkey AS VARCHAR) AS receiver_province_code, n_name AS receiver_province_name,
    o_orderdate AS updated_at
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN areas ON c_nationkey = n_nationkey
),
m_detail AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER),
      strftime(l_shipdate, '%Y%m%d')) AS order_detail_id,
    l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
    {half_up("CAST(l_extendedprice AS DECIMAL(18,2))", "CAST(l_quantity AS INTEGER)", 2)} AS unit_price,
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS discount_amount,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2))
      - CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS actual_amount,
    l_shipdate AS created_at, CAST(l_extendedprice AS DECIMAL(18,2)) AS gross_amount
  FROM lineitem
),
m_customer AS (
  SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS member_level,
    CAST(c_nationkey AS VARCHAR) AS province_code, n_name AS province_name
  FROM customer LEFT JOIN areas ON c_nationkey = n_nationkey
),
m_product AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category_id, p_type AS category_name,
    p_brand AS brand_name, CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price,
    CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.6 AS DECIMAL(2,1)) AS DECIMAL(18,2)) AS cost_price
  FROM part
),
wide AS (
  SELECT d.order_detail_id, d.order_id, d.product_id, d.quantity, d.unit_price, d.discount_amount, d.actual_amount,
    d.created_at AS detail_created_at, o.order_no, o.customer_id, o.order_time, o.order_status, o.order_amount,
    o.coupon_amount, o.freight_amount, o.payable_amount, o.order_channel, o.receiver_province_code,
    o.receiver_province_name, o.updated_at AS order_updated_at, c.customer_name, c.member_level,
    c.province_code AS customer_province_code, c.province_name AS customer_province_name,
    p.product_name, p.category_id, p.category_name, p.brand_name, p.unit_price AS product_standard_price, p.cost_price
  FROM m_detail d LEFT JOIN m_order o ON d.order_id = o.order_id
    LEFT JOIN m_customer c ON o.customer_id = c.customer_id LEFT JOIN m_product p ON d.product_id = p.product_id
),
grain AS (
  SELECT DISTINCT order_id, order_no, customer_id, order_time, order_status, order_amount, coupon_amount, freight_amount,
    payable_amount, order_channel, receiver_province_code, receiver_province_name, customer_name, member_level,
    customer_province_code, customer_province_name
  FROM wide
),
vgrain AS (SELECT * FROM grain WHERE order_status IN {VALID}),
vwide AS (SELECT * FROM wide WHERE order_status IN {VALID}),
users AS (
  SELECT customer_id, customer_name, member_level, customer_province_code, customer_province_name,
    count(DISTINCT order_id) AS order_count, sum(payable_amount) AS total_amount,
    min(order_time) AS first_order_time, max(order_time) AS last_order_time,
    {half_up("sum(payable_amount)", "count(DISTINCT order_id)", 2)} AS avg_order_amount
  FROM vgrain GROUP BY ALL
),
products AS (
  SELECT product_id, product_name, category_id, category_name, brand_name, product_standard_price, cost_price,
    count(DISTINCT order_id) AS sales_order_count, count(DISTINCT order_detail_id) AS sales_detail_count,
    CAST(sum(quantity) AS BIGINT) AS sales_count, sum(actual_amount) AS sales_amount,
    min(order_time) AS first_sale_time, max(order_time) AS last_sale_time,
    {half_up("sum(actual_amount)", "sum(quantity)", 2)} AS avg_sale_price
  FROM vwide GROUP BY product_id, product_name, category_id, category_name, brand_name, product_standard_price, cost_price
),
area_table AS (
  SELECT receiver_province_code, receiver_province_name, count(DISTINCT order_id) AS order_count,
    count(DISTINCT customer_id) AS customer_count, sum(payable_amount) AS sales_amount,
    min(order_time) AS first_order_time, max(order_time) AS last_order_time,
    {half_up("sum(payable_amount)", "count(DISTINCT order_id)", 2)} AS avg_order_amount
  FROM vgrain GROUP BY receiver_province_code, receiver_province_name
),
daily AS (
  SELECT CAST(order_time AS DATE) AS order_date, year(order_time) AS year, month(order_time) AS month,
    strftime(order_time, '%Y-%m') AS year_month, count(DISTINCT order_id) AS order_count,
    count(DISTINCT customer_id) AS customer_count, sum(payable_amount) AS sales_amount,
    {half_up("sum(payable_amount)", "count(DISTINCT order_id)", 2)} AS avg_order_amount,
    sum(coupon_amount) AS coupon_amount, sum(freight_amount) AS freight_amount
  FROM vgrain GROUP BY CAST(order_time AS DATE), year(order_time), month(order_time), strftime(order_time, '%Y-%m')
),
monthly AS (
  SELECT year_month, min(year) AS year, min(month) AS month, count(DISTINCT order_date) AS sales_days,
    CAST(sum(order_count) AS BIGINT) AS order_count, sum(sales_amount) AS sales_amount,
    {half_up("sum(sales_amount)", "sum(order_count)", 2)} AS avg_order_amount,
    sum(coupon_amount) AS coupon_amount, sum(freight_amount) AS freight_amount
  FROM daily GROUP BY year_month
),
lagged AS (
  SELECT *, lag(order_count) OVER (ORDER BY year_month) AS previous_month_order_count,
    lag(sales_amount) OVER (ORDER BY year_month) AS previous_month_sales_amount,
    sum(order_count) OVER (ORDER BY year_month) AS cumulative_order_count,
    sum(sales_amount) OVER (ORDER BY year_month) AS cumulative_sales_amount
  FROM monthly
),
trend AS (
  SELECT *,
    {half_up("(order_count - previous_month_order_count)", "previous_month_order_count", 4, False)} AS order_count_mom_rate,
    {half_up("(sales_amount - previous_month_sales_amount)", "previous_month_sales_amount", 4, True, True)} AS sales_amount_mom_rate
  FROM lagged
),
rfm AS (
  SELECT customer_id, customer_name, member_level, first_order_time, last_order_time,
    date_diff('day', CAST(last_order_time AS DATE), ref.d) AS recency_days,
    order_count AS frequency, total_amount AS monetary, ref.d AS rfm_reference_date
  FROM users, (SELECT CAST(max(last_order_time) AS DATE) + 1 AS d FROM users) ref
),
ntile_scores AS (
  SELECT *, r_score + f_score + m_score AS rfm_total_score FROM (
    SELECT *, ntile(5) OVER (ORDER BY recency_days DESC, customer_id) AS r_score,
      ntile(5) OVER (ORDER BY frequency, customer_id) AS f_score,
      ntile(5) OVER (ORDER BY monetary, customer_id) AS m_score
    FROM rfm)
),
percent_parts AS (
  SELECT *, count(*) OVER () AS n,
    rank() OVER (ORDER BY recency_days) - 1 AS rb, count(*) OVER (PARTITION BY recency_days) AS rt,
    rank() OVER (ORDER BY frequency) - 1 AS fb, count(*) OVER (PARTITION BY frequency) AS ft,
    rank() OVER (ORDER BY monetary) - 1 AS mb, count(*) OVER (PARTITION BY monetary) AS mt
  FROM rfm
),
percent_scores AS (
  SELECT *, r_score + f_score + m_score AS rfm_score, concat(r_score, f_score, m_score) AS rfm_code FROM (
    SELECT *, 6 - greatest(1, least(5, (5 * (2 * rb + rt + 1) + 2 * n - 1) // (2 * n))) AS r_score,
      greatest(1, least(5, (5 * (2 * fb + ft + 1) + 2 * n - 1) // (2 * n))) AS f_score,
      greatest(1, least(5, (5 * (2 * mb + mt + 1) + 2 * n - 1) // (2 * n))) AS m_score
    FROM percent_parts)
),
segmented AS (SELECT *, {segment_case()} AS user_segment FROM ntile_scores),
psegmented AS (SELECT *, {segment_case()} AS user_segment FROM percent_scores),
segment_table AS (
  SELECT user_segment, count(DISTINCT customer_id) AS user_count,
    {half_up("sum(recency_days)", "count(*)", 2, False)} AS avg_recency,
    {half_up("sum(frequency)", "count(*)", 2, False)} AS avg_frequency,
    sum(monetary) AS total_monetary, {half_up("sum(monetary)", "count(*)", 2)} AS avg_monetary,
    {half_up("sum(r_score)", "count(*)", 2, False)} AS avg_r_score,
    {half_up("sum(f_score)", "count(*)", 2, False)} AS avg_f_score,
    {half_up("sum(m_score)", "count(*)", 2, False)} AS avg_m_score,
    {half_up("count(*)", "(SELECT count(*) FROM segmented)", 4, False)} AS user_rate,
    {half_up("count(*) * 100", "(SELECT count(*) FROM segmented)", 2, False)} AS user_percent
  FROM segmented GROUP BY user_segment
),
ranked0 AS (
  SELECT *, row_number() OVER (ORDER BY sales_amount DESC, product_id) AS sales_amount_rank,
    sum(sales_amount) OVER (ORDER BY sales_amount DESC, product_id ROWS UNBOUNDED PRECEDING) AS cumulative_sales_amount,
    sum(sales_amount) OVER () AS total_sales
  FROM products
),
ranked AS (
  SELECT *, {half_up("sales_amount", "total_sales", 8, True, True)} AS sales_amount_rate,
    {half_up("cumulative_sales_amount", "total_sales", 8, True, True)} AS cumulative_sales_amount_rate,
    CASE WHEN cumulative_sales_amount * 100 <= total_sales * 80 THEN 'A类'
      WHEN cumulative_sales_amount * 100 <= total_sales * 95 THEN 'B类' ELSE 'C类' END AS abc_level
  FROM ranked0
),
abc_table AS (
  SELECT abc_level, count(DISTINCT product_id) AS product_count, sum(sales_count) AS sales_count,
    sum(sales_amount) AS sales_amount,
    {half_up("sum(sales_amount)", "max(total_sales)", 4, True, True)} AS sales_amount_rate
  FROM ranked GROUP BY abc_level
),
f_order0 AS (
  SELECT * REPLACE (
    CAST(order_amount + CASE WHEN order_id % 97 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS order_amount,
    CASE WHEN order_id % 101 = 0 THEN 'X' ELSE order_status END AS order_status,
    CASE WHEN order_id % 103 = 0 THEN 'C_MISSING' ELSE CAST(customer_id AS VARCHAR) END AS customer_id)
  FROM m_order
),
f_order AS (
  SELECT * REPLACE (CAST(order_id AS VARCHAR) AS order_id)
  FROM (SELECT * FROM f_order0 UNION ALL SELECT * FROM f_order0 WHERE order_id % 131 = 0)
),
f_detail AS (
  SELECT * REPLACE (
    CAST(actual_amount + CASE WHEN order_id % 89 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS actual_amount,
    CASE WHEN order_id % 109 = 0 THEN -1 ELSE quantity END AS quantity,
    CASE WHEN order_id % 107 = 0 THEN 'P_MISSING' ELSE CAST(product_id AS VARCHAR) END AS product_id,
    CAST(order_id AS VARCHAR) AS order_id)
  FROM m_detail
),
f_customer AS (
  SELECT * REPLACE (CASE WHEN customer_id % 113 <> 0 THEN customer_name END AS customer_name,
    CAST(customer_id AS VARCHAR) AS customer_id) FROM m_customer
),
f_product AS (
  SELECT * REPLACE (CASE WHEN product_id % 127 <> 0 THEN category_name END AS category_name,
    CAST(product_id AS VARCHAR) AS product_id) FROM m_product
)"""
