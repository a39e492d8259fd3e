"""Quality rules, rule report and score, relations, reconciliation of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.model_sql import half_up
from checks.registry import Tables, query
from checks.text_tables import text_order, with_text
from martloom.operators import gates, quality
from martloom.operators.quality import RuleSet
from martloom.sources.retail import ALL_STATUSES



def _expected():
    return F.col("gross_amount") - F.col("discount_amount")


QUANTITIES = (1, 50)


@query(
    "null_profile",
    "field:s nulls:i null_percent:d",
    "SELECT field, nulls, null_percent FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS field, count(*) - count({c}) AS nulls, {half_up(f'((count(*) - count({c})) * 100)', 'count(*)', 2, False)} AS null_percent FROM f_customer"
        for c in ("customer_id", "customer_name", "member_level", "province_code", "province_name")
    )
    + ")",
)
def null_profile(t: Tables):
    columns = ["customer_id", "customer_name", "member_level", "province_code", "province_name"]
    return quality.null_profile(t.faulty.customer().select(*columns))


@query(
    "rule_null",
    "customer_id:s member_level:s",
    "SELECT customer_id, member_level FROM f_customer WHERE customer_name IS NULL",
)
def rule_null(t: Tables):
    return quality.rule_null(t.faulty.customer(), ["customer_id", "customer_name", "member_level"])


DECLARED = {
    "order_id": "string",
    "order_status": "string",
    "coupon_amount": "number",
    "payable_amount": "number",
    "warehouse_code": "string",
}


@query(
    "rule_type",
    "field:s bad:i",
    with_text(
        """SELECT 'order_id' AS field, 0 AS bad UNION ALL SELECT 'order_status', 0
    UNION ALL SELECT 'coupon_amount', count(*) FILTER (WHERE TRY_CAST(coupon_amount AS DOUBLE) IS NULL) FROM text_order
    UNION ALL SELECT 'payable_amount', 0 UNION ALL SELECT 'warehouse_code', 1"""
    ),
)
def rule_type(t: Tables):
    return quality.rule_type(text_order(t), DECLARED)


@query(
    "rule_duplicate",
    "order_id:s customer_id:s payable_amount:d",
    """SELECT order_id, customer_id, payable_amount FROM (
    SELECT *, count(*) OVER (PARTITION BY order_id) AS n FROM f_order) WHERE n > 1""",
)
def rule_duplicate(t: Tables):
    return quality.rule_duplicate(t.faulty.order(), ["order_id"])


_PK = "SELECT count(*) - count(DISTINCT order_id) AS extra_rows, (SELECT count(*) FROM (SELECT order_id FROM f_order GROUP BY order_id HAVING count(*) > 1)) AS duplicate_keys FROM f_order"


@query("pk_duplicates", "extra_rows:i duplicate_keys:i", _PK)
def pk_duplicates(t: Tables):
    return quality.pk_duplicates(t.faulty.order(), "order_id")


@query(
    "key_blank_check",
    "column_name:s blank_rows:i",
    """SELECT 'customer_id' AS column_name, count(*) FILTER (WHERE trim(customer_id) = '') AS blank_rows FROM f_customer
    UNION ALL SELECT 'customer_name', count(*) FILTER (WHERE customer_name IS NULL OR trim(customer_name) = '') FROM f_customer""",
)
def key_blank_check(t: Tables):
    return quality.key_blank_check(t.faulty.customer(), ["customer_id", "customer_name"])


@query(
    "enum_check",
    "order_id:s order_status:s",
    "SELECT order_id, order_status FROM f_order WHERE order_status NOT IN ('F', 'O', 'P') OR order_status IS NULL",
)
def enum_check(t: Tables):
    return quality.enum_check(t.faulty.order(), "order_status", ALL_STATUSES)


@query(
    "range_check",
    "order_detail_id:s quantity:i",
    "SELECT order_detail_id, quantity FROM f_detail WHERE quantity NOT BETWEEN 1 AND 5",
)
def range_check(t: Tables):
    return quality.range_check(t.faulty.detail(), "quantity", 1, 5)


@query(
    "rule_business_formula",
    "order_id:s payable_amount:d order_amount:d",
    "SELECT order_id, payable_amount, order_amount FROM f_order WHERE payable_amount <> order_amount - coupon_amount + freight_amount",
)
def rule_business_formula(t: Tables):
    return quality.rule_business_formula(t.faulty.order())


@query(
    "rule_amount",
    "order_id:s net_amount:d",
    """SELECT order_id, payable_amount - 5000 AS net_amount FROM f_order WHERE payable_amount - 5000 < 0""",
)
def rule_amount(t: Tables):
    """The test amounts are all positive, so amounts after a fixed rebate are checked."""
    rebated = t.faulty.order().withColumn("payable_amount", F.col("payable_amount") - 5000)
    return quality.rule_amount(rebated).withColumn("net_amount", F.col("payable_amount"))


@query(
    "rule_count",
    "rule_name:s status:s error_count:i row_count:i",
    """SELECT 'CountRule' AS rule_name, CASE WHEN count(*) < 5000 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
    CASE WHEN count(*) < 5000 THEN 1 ELSE 0 END AS error_count, count(*) AS row_count FROM f_order""",
)
def rule_count(t: Tables):
    return quality.rule_count(t.faulty.order())


# Orders with the customer's name, so that the NULL rule has something to find.
def _named_orders(t: Tables):
    names = t.faulty.customer().select("customer_id", "customer_name")
    return t.faulty.order().join(names, "customer_id", "left")


RULES = RuleSet(
    keys=["order_id"],
    declared={"order_id": "string", "payable_amount": "number", "warehouse_code": "string"},
    null_columns=["order_id", "customer_name"],
)
_SUITE = """named AS (SELECT o.*, c.customer_name FROM f_order o LEFT JOIN f_customer c ON o.customer_id = c.customer_id),
suite AS (
  SELECT 'NullRule' AS rule_name, count(*) FILTER (WHERE customer_name IS NULL) AS error_count, 'HIGH' AS severity, '存在空值' AS bad, '无空值' AS good FROM named
  UNION ALL SELECT 'DuplicateRule', (SELECT count(*) FROM (SELECT count(*) OVER (PARTITION BY order_id) AS n FROM named) WHERE n > 1), 'MEDIUM', '存在重复数据', '无重复数据'
  UNION ALL SELECT 'TypeRule', 1, 'HIGH', '字段类型错误', '字段类型正常'
  UNION ALL SELECT 'BusinessRule', (SELECT count(*) FROM named WHERE payable_amount <> order_amount - coupon_amount + freight_amount), 'HIGH', '订单金额异常', '业务校验通过'
  UNION ALL SELECT 'AmountRule', (SELECT count(*) FROM named WHERE payable_amount < 0), 'MEDIUM', '存在负金额', '金额校验通过'
  UNION ALL SELECT 'CountRule', (SELECT CASE WHEN count(*) < 5000 THEN 1 ELSE 0 END FROM named), 'LOW', '数据量异常', '数据量正常'
),
report AS (SELECT rule_name, CASE WHEN error_count > 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, error_count, severity,
  CASE WHEN error_count > 0 THEN bad ELSE good END AS message FROM suite)"""


@query(
    "rule_suite",
    "rule_name:s status:s error_count:i severity:s message:s",
    f"WITH {_SUITE} SELECT * FROM report",
)
def rule_suite(t: Tables):
    return quality.rule_suite(_named_orders(t), RULES)


_SCORES = f"""WITH {_SUITE},
weighted AS (SELECT *, CASE rule_name WHEN 'NullRule' THEN 30 WHEN 'DuplicateRule' THEN 20 WHEN 'TypeRule' THEN 20
  WHEN 'BusinessRule' THEN 20 WHEN 'AmountRule' THEN 10 ELSE 0 END AS weight FROM report),
scored AS (SELECT *, CASE WHEN status = 'SUCCESS' THEN CAST(weight AS DECIMAL(18,2))
  ELSE greatest(0, weight - CAST(error_count AS DECIMAL(18,2)) / 10) END AS score FROM weighted)"""


@query(
    "quality_score",
    "total_score:d level:s",
    f"""{_SCORES}, total AS (SELECT round(100 - sum(weight - score), 2) AS total_score FROM scored)
    SELECT total_score, CASE WHEN total_score >= 90 THEN 'A级' WHEN total_score >= 80 THEN 'B级'
    WHEN total_score >= 60 THEN 'C级' ELSE 'D级' END AS level FROM total""",
)
def quality_score(t: Tables):
    return quality.quality_score(quality.rule_suite(_named_orders(t), RULES))


@query(
    "quality_score_detail",
    "rule_name:s score:d weight:d status:s error_count:i severity:s",
    f"{_SCORES} SELECT rule_name, round(score, 2) AS score, weight, status, error_count, severity FROM scored",
)
def quality_score_detail(t: Tables):
    return quality.score_detail(quality.rule_suite(_named_orders(t), RULES))


@query(
    "error_rows",
    "order_id:s rule_name:s severity:s payable_amount:d",
    """WITH named AS (SELECT o.*, c.customer_name FROM f_order o LEFT JOIN f_customer c ON o.customer_id = c.customer_id)
    SELECT order_id, 'NullRule' AS rule_name, 'HIGH' AS severity, payable_amount FROM named WHERE customer_name IS NULL
    UNION ALL SELECT order_id, 'BusinessRule', 'HIGH', payable_amount FROM named WHERE payable_amount <> order_amount - coupon_amount + freight_amount
    UNION ALL SELECT order_id, 'DuplicateRule', 'MEDIUM', payable_amount FROM (SELECT *, count(*) OVER (PARTITION BY order_id) AS n FROM named) WHERE n > 1""",
)
def error_rows(t: Tables):
    return quality.error_rows(_named_orders(t), RULES)


@query(
    "union_by_name",
    "order_id:s customer_id:s source:s note:s",
    """SELECT order_id, customer_id, 'enum' AS source, order_status AS note FROM f_order WHERE order_status = 'X'
    UNION ALL SELECT order_id, customer_id, 'customer' AS source, NULL FROM f_order WHERE customer_id = 'C_MISSING'""",
)
def union_by_name(t: Tables):
    """Error rows of two rules whose columns differ, concatenated by name."""
    o = t.faulty.order()
    enum = quality.enum_check(o, "order_status", ALL_STATUSES).select(
        "order_id", "customer_id", F.lit("enum").alias("source"), F.col("order_status").alias("note")
    )
    lost = quality.orphans(o, t.faulty.customer(), "customer_id").select(
        "customer_id", "order_id", F.lit("customer").alias("source")
    )
    return enum.unionByName(lost, allowMissingColumns=True)


@query(
    "orphans",
    "relation:s orphan_rows:i orphan_keys:i",
    """SELECT 'detail_without_order' AS relation, count(*) AS orphan_rows, count(DISTINCT order_id) AS orphan_keys FROM f_detail WHERE order_id NOT IN (SELECT order_id FROM f_order)
    UNION ALL SELECT 'order_without_customer', count(*), count(DISTINCT customer_id) FROM f_order WHERE customer_id NOT IN (SELECT customer_id FROM f_customer)
    UNION ALL SELECT 'detail_without_product', count(*), count(DISTINCT product_id) FROM f_detail WHERE product_id NOT IN (SELECT product_id FROM f_product)
    UNION ALL SELECT 'order_without_detail', count(*), count(DISTINCT order_id) FROM f_order WHERE order_id NOT IN (SELECT order_id FROM f_detail)""",
)
def orphans(t: Tables):
    f = t.faulty
    return quality.relation_checks(f.order(), f.detail(), f.customer(), f.product())


@query(
    "orphan_rows",
    "order_id:i payable_amount:d",
    "SELECT order_id, payable_amount FROM m_order o WHERE NOT EXISTS (SELECT 1 FROM m_detail d WHERE d.order_id = o.order_id)",
)
def orphan_rows(t: Tables):
    return quality.orphans(t.clean.order(), t.clean.detail(), "order_id", parent_is_many=True)


@query(
    "price_sanity",
    "negative_price:i negative_cost:i cost_above_price:i",
    """SELECT count(*) FILTER (WHERE unit_price < 0) AS negative_price, count(*) FILTER (WHERE cost_price < 0) AS negative_cost,
    count(*) FILTER (WHERE cost_price > unit_price) AS cost_above_price FROM f_product""",
)
def price_sanity(t: Tables):
    return quality.price_sanity(t.faulty.product())


@query(
    "value_distribution",
    "order_status:s row_count:i",
    "SELECT order_status, count(*) AS row_count FROM f_order GROUP BY order_status",
)
def value_distribution(t: Tables):
    return quality.value_distribution(t.faulty.order(), "order_status")


def _percentiles(column: str, table: str = "m_detail", digits: int = 2) -> str:
    parts = []
    for p in quality.PERCENTS:
        lo, hi = f"(n - 1) * {p} // 100", f"((n - 1) * {p} + 99) // 100"
        parts.append(
            f"(max(v) FILTER (WHERE i = {lo}) * (100 - max((n - 1) * {p} % 100)) + max(v) FILTER (WHERE i = {hi}) * max((n - 1) * {p} % 100)) * 0.01 AS p{p}"
        )
    mean = half_up("sum(v)", "count(*)", 2)
    if digits != 2:  # in whole numbers of the last decimal
        unit = 10**digits
        mean = f"CAST((CAST(sum(v) * {unit} AS HUGEINT) * 2 + count(*)) // (2 * count(*)) AS DOUBLE) / {unit}"
    return f"""SELECT '{column}' AS column_name, count(*) AS row_count, {mean} AS mean,
    min(v) AS min, max(v) AS max, {", ".join(parts)} FROM (
      SELECT CAST({column} AS DECIMAL(18,{digits})) AS v, row_number() OVER (ORDER BY {column}) - 1 AS i, count(*) OVER () AS n FROM {table})"""


@query(
    "numeric_summary",
    "column_name:s row_count:i mean:d min:d max:d p25:d p50:d p75:d p90:d p99:d",
    _percentiles("quantity") + " UNION ALL " + _percentiles("actual_amount"),
)
def numeric_summary(t: Tables):
    return quality.numeric_summary(t.clean.detail(), ["quantity", "actual_amount"])


_FINE = "CAST(CAST(payable_amount AS DECIMAL(18,4)) * 3 + CAST(order_id % 7 AS DECIMAL(18,4)) * 0.0011 AS DECIMAL(18,4))"


@query(
    "numeric_summary_fine",
    "column_name:s row_count:i mean:d min:d max:d p25:d p50:d p75:d p90:d p99:d",
    _percentiles("fine", f"(SELECT {_FINE} AS fine FROM m_order) AS fine_table", 4),
)
def numeric_summary_fine(t: Tables):
    """A column with four decimals: nothing may be cut."""
    return quality.numeric_summary(t.clean.order().select(F.expr(_FINE).alias("fine")), ["fine"])


_TINY = "CAST(l_discount AS DOUBLE) / 3e6 + l_orderkey * 1e-9"


@query(
    "numeric_summary_double",
    "column_name:s row_count:i min:d max:d p25:d p50:d p75:d p90:d p99:d",
    " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, count(*) AS row_count, min(v) AS min, max(v) AS max, "
        + ", ".join(
            f"max(v) FILTER (WHERE i = (n - 1) * {p} // 100) * (1 - max((n - 1) * {p} % 100) / 100.0::DOUBLE)"
            f" + max(v) FILTER (WHERE i = ((n - 1) * {p} + 99) // 100) * (max((n - 1) * {p} % 100) / 100.0::DOUBLE) AS p{p}"
            for p in quality.PERCENTS
        )
        + f" FROM (SELECT {v} AS v, row_number() OVER (ORDER BY {v}) - 1 AS i, count(*) OVER () AS n FROM lineitem)"
        for name, v in {"tiny": f"round(({_TINY}) * 1e7)", "huge": "l_extendedprice * 1e20"}.items()
    ),
)
def numeric_summary_double(t: Tables):
    """Floating-point columns, of small whole numbers and of numbers beyond every decimal."""
    tiny = F.round((F.col("l_discount") / 3e6 + F.col("l_orderkey") * 1e-9) * 1e7)
    rows = t.clean.raw("lineitem").select(tiny.alias("tiny"), (F.col("l_extendedprice") * 1e20).alias("huge"))
    return quality.numeric_summary(rows, ["tiny", "huge"])


def _gate_sql() -> str:
    keys = {"order": "order_id", "detail": "order_detail_id", "customer": "customer_id", "product": "product_id"}
    parts = []
    for name, key in keys.items():
        parts.append(f"SELECT '{name}_key_blank' AS gate, count(*) FILTER (WHERE {key} IS NULL OR trim(CAST({key} AS VARCHAR)) = '') AS errors FROM f_{name}")
        parts.append(f"SELECT '{name}_key_repeated', count({key}) - count(DISTINCT {key}) FROM f_{name}")
    for child, parent, key in gates.RELATIONS:
        parts.append(f"SELECT '{child}_without_{parent}', count(*) FROM f_{child} WHERE {key} IS NULL OR {key} NOT IN (SELECT {key} FROM f_{parent})")
    return " UNION ALL ".join(parts)


@query("layer_gates", "gate:s errors:i", _gate_sql())
def layer_gates(t: Tables):
    return gates.layer_gates(t.faulty.order(), t.faulty.detail(), t.faulty.customer(), t.faulty.product())


@query(
    "detail_formula",
    "order_detail_id:s actual_amount:d",
    "SELECT order_detail_id, actual_amount FROM f_detail WHERE abs(actual_amount - (gross_amount - discount_amount)) > 0.01",
)
def detail_formula(t: Tables):
    return quality.detail_formula(t.faulty.detail(), _expected())


@query(
    "detail_time_order",
    "order_detail_id:s created_at:t order_time:t",
    """SELECT order_detail_id, created_at, order_time FROM m_detail d JOIN m_order o ON d.order_id = o.order_id
    WHERE created_at < order_time""",
)
def detail_time_order(t: Tables):
    return quality.detail_time_order(t.clean.detail(), t.clean.order())


_HEADER_SQL = """header AS (SELECT DISTINCT order_id, order_amount, coupon_amount, freight_amount, payable_amount FROM f_order),
sums AS (SELECT order_id, sum(actual_amount) AS detail_amount, count(*) AS detail_count FROM f_detail GROUP BY order_id),
compared AS (SELECT h.*, detail_amount, detail_count, abs(detail_amount - order_amount) AS order_amount_difference,
  order_amount - coupon_amount + freight_amount AS calculated_payable_amount,
  abs(order_amount - coupon_amount + freight_amount - payable_amount) AS payable_difference FROM sums JOIN header h USING (order_id)),
matched AS (SELECT *, order_amount_difference <= 0.01 AS order_amount_match, payable_difference <= 0.01 AS payable_match FROM compared)"""


def _reconciled(t: Tables):
    order = t.faulty.order().dropDuplicates()
    columns = ("order_amount", "coupon_amount", "freight_amount", "payable_amount")
    rows = t.faulty.detail().select("order_id", "actual_amount").join(
        order.select("order_id", *columns), "order_id", "left"
    )
    return quality.header_detail_reconcile(rows)


@query(
    "header_detail_reconcile",
    "order_id:s order_amount:d detail_amount:d detail_count:i order_amount_difference:d calculated_payable_amount:d payable_difference:d order_amount_match:b payable_match:b",
    f"WITH {_HEADER_SQL} SELECT * FROM matched",
)
def header_detail_reconcile(t: Tables):
    return _reconciled(t)


@query(
    "header_detail_totals",
    "order_count:i order_amount_matches:i payable_matches:i error_orders:i detail_amount_total:d order_amount_total:d coupon_amount_total:d freight_amount_total:d payable_amount_total:d",
    f"""WITH {_HEADER_SQL} SELECT count(*) AS order_count, count(*) FILTER (WHERE order_amount_match) AS order_amount_matches,
    count(*) FILTER (WHERE payable_match) AS payable_matches,
    count(*) FILTER (WHERE NOT (order_amount_match AND payable_match)) AS error_orders,
    sum(detail_amount) AS detail_amount_total, sum(order_amount) AS order_amount_total, sum(coupon_amount) AS coupon_amount_total,
    sum(freight_amount) AS freight_amount_total, sum(payable_amount) AS payable_amount_total FROM matched""",
)
def header_detail_totals(t: Tables):
    return quality.reconcile_totals(_reconciled(t))


@query(
    "integrity_suite",
    "rule:s errors:i",
    """WITH sums AS (SELECT order_id, sum(actual_amount) AS s FROM f_detail GROUP BY order_id),
    times AS (SELECT order_id, min(order_time) AS t FROM f_order GROUP BY order_id)
    SELECT 'order_key' AS rule, count(*) - count(DISTINCT order_id) AS errors FROM f_order
    UNION ALL SELECT 'order_detail_key', count(*) - count(DISTINCT order_detail_id) FROM f_detail
    UNION ALL SELECT 'customer_key', count(*) - count(DISTINCT customer_id) FROM f_customer
    UNION ALL SELECT 'product_key', count(*) - count(DISTINCT product_id) FROM f_product
    UNION ALL SELECT 'order_customer', count(*) FROM f_order WHERE customer_id NOT IN (SELECT customer_id FROM f_customer)
    UNION ALL SELECT 'detail_order', count(*) FROM f_detail WHERE order_id NOT IN (SELECT order_id FROM f_order)
    UNION ALL SELECT 'detail_product', count(*) FROM f_detail WHERE product_id NOT IN (SELECT product_id FROM f_product)
    UNION ALL SELECT 'quantity_range', count(*) FROM f_detail WHERE quantity NOT BETWEEN 1 AND 50
    UNION ALL SELECT 'actual_amount_formula', count(*) FROM f_detail WHERE abs(actual_amount - (gross_amount - discount_amount)) > 0.01
    UNION ALL SELECT 'detail_time', count(*) FROM f_detail d JOIN times USING (order_id) WHERE created_at < t
    UNION ALL SELECT 'order_amount_sum', count(*) FROM f_order o LEFT JOIN sums USING (order_id) WHERE s IS NULL OR abs(order_amount - s) > 0.01
    UNION ALL SELECT 'payable_formula', count(*) FROM f_order WHERE abs(payable_amount - (order_amount - coupon_amount + freight_amount)) > 0.01""",
)
def integrity_suite(t: Tables):
    f = t.faulty
    return quality.integrity_suite(f.order(), f.detail(), f.customer(), f.product(), _expected(), QUANTITIES)


@query(
    "anomaly_manifest",
    "dataset:s row_id:s rule_code:s field:s value:s description:s occurrences:i",
    """WITH times AS (SELECT order_id, min(order_time) AS t FROM f_order GROUP BY order_id),
    notes(rule_code, dataset, description) AS (VALUES ('QUANTITY_RANGE', 'order_detail', '商品数量超出1至5'),
      ('DETAIL_AMOUNT_FORMULA', 'order_detail', '明细金额不等于数量乘单价减优惠'), ('PRODUCT_FK', 'order_detail', '商品主数据不存在'),
      ('DETAIL_TIME', 'order_detail', '明细时间早于订单时间'), ('CUSTOMER_FK', 'order', '客户主数据不存在'),
      ('ORDER_AMOUNT_FORMULA', 'order', '应付金额公式异常'), ('ORDER_STATUS_ENUM', 'order', '订单状态不在标准枚举中'),
      ('CUSTOMER_NAME_NULL', 'customer', '客户名称为空'), ('CATEGORY_NULL', 'product', '商品分类为空'),
      ('DUPLICATE_ROW', 'order', '订单整行重复'), ('DUPLICATE_ROW', 'order_detail', '订单明细整行重复')),
    doubled AS (SELECT * FROM f_detail UNION ALL SELECT * FROM f_detail WHERE CAST(order_id AS BIGINT) % 211 = 0),
    found AS (SELECT 'order_detail' AS dataset, order_detail_id AS row_id, 'QUANTITY_RANGE' AS rule_code, 'quantity' AS field, CAST(quantity AS VARCHAR) AS value, 1 AS occurrences FROM doubled WHERE quantity NOT BETWEEN 1 AND 50
    UNION ALL SELECT 'order_detail', order_detail_id, 'DETAIL_AMOUNT_FORMULA', 'actual_amount', CAST(actual_amount AS VARCHAR), 1 FROM doubled WHERE abs(actual_amount - (gross_amount - discount_amount)) > 0.01
    UNION ALL SELECT 'order_detail', order_detail_id, 'PRODUCT_FK', 'product_id', product_id, 1 FROM doubled WHERE product_id NOT IN (SELECT product_id FROM f_product)
    UNION ALL SELECT 'order_detail', order_detail_id, 'DETAIL_TIME', 'created_at', strftime(created_at, '%Y-%m-%d %H:%M:%S'), 1 FROM doubled JOIN times USING (order_id) WHERE created_at < t
    UNION ALL SELECT 'order', order_id, 'CUSTOMER_FK', 'customer_id', customer_id, 1 FROM f_order WHERE customer_id NOT IN (SELECT customer_id FROM f_customer)
    UNION ALL SELECT 'order', order_id, 'ORDER_AMOUNT_FORMULA', 'payable_amount', CAST(payable_amount AS VARCHAR), 1 FROM f_order WHERE abs(payable_amount - (order_amount - coupon_amount + freight_amount)) > 0.01
    UNION ALL SELECT 'order', order_id, 'ORDER_STATUS_ENUM', 'order_status', order_status, 1 FROM f_order WHERE order_status NOT IN ('F', 'O', 'P')
    UNION ALL SELECT 'customer', customer_id, 'CUSTOMER_NAME_NULL', 'customer_name', NULL, 1 FROM f_customer WHERE customer_name IS NULL
    UNION ALL SELECT 'product', product_id, 'CATEGORY_NULL', 'category_name', NULL, 1 FROM f_product WHERE category_name IS NULL
    UNION ALL SELECT 'order', order_id, 'DUPLICATE_ROW', 'all', 'duplicate', count(*) - 1 FROM f_order GROUP BY order_id HAVING count(*) > 1
    UNION ALL SELECT 'order_detail', order_detail_id, 'DUPLICATE_ROW', 'all', 'duplicate', count(*) - 1 FROM doubled GROUP BY order_detail_id HAVING count(*) > 1)
    SELECT * FROM found JOIN notes USING (dataset, rule_code)""",
)
def anomaly_manifest(t: Tables):
    f = t.faulty
    detail = f.detail()
    doubled = detail.unionByName(detail.where(F.col("order_id").cast("bigint") % 211 == 0))
    return quality.anomaly_manifest(
        f.order(), doubled, f.customer(), f.product(), ALL_STATUSES, _expected(), QUANTITIES
    )
