"""Data-quality rules, rule report, score, integrity checks."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martloom.functions import fixed
from martloom.functions.columns import any_of, beside, count_if, half_up, is_blank, meets, to_rows
from martloom.operators.rank import global_rank
from martloom.session import stage


# ---- profiles ------------------------------------------------------------


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: NULLs and their percentage, from one aggregate."""
    names = df.columns
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[count_if(F.col(c).isNull()).alias(c) for c in names])
    rows = one.select(
        "__n",
        F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("nulls")) for c in names])),
    )
    return rows.select("field", "nulls", half_up(F.col("nulls") * 100, F.col("__n"), 2).alias("null_percent"))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count")).orderBy(F.desc("row_count"), column)


PERCENTS = (25, 50, 75, 90, 99)


def numeric_summary(df: DataFrame, columns) -> DataFrame:
    """Per column: count, mean, min, max and exact interpolated percentiles, all columns from one ranking.

    Distinct values of all columns, each in its column's own type and with its
    count, are ordered together once; running counts tell where a percentile
    lies, so no task ever holds a whole column. Numbers with decimals keep those
    of their column (two at least), percentiles have two more; with a
    floating-point column among them all results are doubles. A column without
    values has count 0. NULLs do not count.
    """
    columns = list(columns)
    kinds = [df.schema[c].dataType for c in columns]
    floating = [isinstance(k, T.FractionalType) and not isinstance(k, T.DecimalType) for k in kinds]
    digits = [max(2, k.scale) if isinstance(k, T.DecimalType) else 2 for k in kinds]
    own = [f"v{i}" for i in range(len(columns))]

    def value(i: int) -> Column:
        return F.col(columns[i]).cast("double" if floating[i] else f"decimal(38,{digits[i]})")

    def nothing(i: int) -> Column:
        return F.lit(None).cast("double" if floating[i] else f"decimal(38,{digits[i]})")

    each = [F.struct(F.lit(i).alias("c"), *[(value(i) if j == i else nothing(j)).alias(v) for j, v in enumerate(own)]) for i in range(len(columns))]
    present = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), e) for c, e in zip(columns, each)]))
    counts = df.select(F.inline(present)).groupBy("c", *own).agg(F.count(F.lit(1)).alias("same"))
    placed = global_rank(counts, [F.asc("c"), *[F.asc(v) for v in own]], running={"up_to": "same"})
    # Rows of each column, and of the columns before it; one row.
    of = [F.coalesce(F.sum(F.when(F.col("c") == i, F.col("same"))), F.lit(0)).cast("bigint") for i in range(len(columns))]
    sizes = placed.agg(F.array(*of).alias("n")).scalar()
    placed = placed.withColumn("n", sizes)
    before = F.aggregate(F.slice("n", 1, F.col("c")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    placed = placed.withColumns({"n": F.get("n", F.col("c")), "below": F.col("up_to") - F.col("same") - before})
    place = {p: (F.col("n") - 1) * p for p in PERCENTS}

    def at(i: int, index: Column) -> Column:
        hit = (F.col("c") == i) & (F.col("below") <= index) & (index < F.col("below") + F.col("same"))
        return F.max(F.when(hit, F.col(own[i])))

    picks = []
    for i, v in enumerate(own):
        if floating[i]:
            mean = F.sum(F.col(v) * F.col("same")) / F.sum(F.when(F.col("c") == i, F.col("same")))
        else:
            total = F.sum(F.col(v) * F.when(F.col("c") == i, F.col("same"))).cast(f"decimal(38,{digits[i]})")
            mean = half_up(total, F.sum(F.when(F.col("c") == i, F.col("same"))), digits[i], digits[i])
        picks.append(
            F.struct(
                F.lit(columns[i]).alias("column_name"),
                F.coalesce(F.max(F.when(F.col("c") == i, F.col("n"))), F.lit(0)).alias("n"),
                mean.alias("mean"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                *[at(i, F.call_function("div", place[p], F.lit(100))).alias(f"lo{p}") for p in PERCENTS],
                *[at(i, F.call_function("div", place[p] + 99, F.lit(100))).alias(f"hi{p}") for p in PERCENTS],
            ).alias(f"s{i}")
        )
    one = placed.agg(*picks)
    wide = "double" if any(floating) else f"decimal(28,{max(digits, default=2)})"
    wider = "double" if any(floating) else f"decimal(28,{max(digits, default=2) + 2})"

    def between(i: int, p: int) -> Column:
        s = F.col(f"s{i}")
        lo, hi, share = s[f"lo{p}"], s[f"hi{p}"], ((s["n"] - 1) * p) % 100
        part = share.cast("double") / 100 if floating[i] else share * F.lit(Decimal("0.01"))
        return (lo * (1 - part) + hi * part if floating[i] else lo + (hi - lo) * part).cast(wider)

    rows = [
        F.struct(
            F.col(f"s{i}.column_name").alias("column_name"),
            F.col(f"s{i}.n").alias("row_count"),
            *[F.col(f"s{i}.{name}").cast(wide).alias(name) for name in ("mean", "min", "max")],
            *[between(i, p).alias(f"p{p}") for p in PERCENTS],
        )
        for i in range(len(columns))
    ]
    return one.select(F.inline(F.array(*rows)))


# ---- row rules -----------------------------------------------------------


def any_null(columns) -> Column:
    return any_of([F.col(c).isNull() for c in columns])


def rule_null(df: DataFrame, columns=None) -> DataFrame:
    return df.filter(any_null(columns or df.columns))


def outside_set(column: str, allowed) -> Column:
    """NULL counts as outside."""
    return ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))


def enum_check(df: DataFrame, column: str, allowed) -> DataFrame:
    return df.filter(outside_set(column, allowed))


def outside_range(column: str, low, high, nulls_outside: bool = True) -> Column:
    inside = F.col(column).between(low, high)
    return ~F.coalesce(inside, F.lit(not nulls_outside))


def range_check(df: DataFrame, column: str, low, high, nulls_outside: bool = True) -> DataFrame:
    return df.filter(outside_range(column, low, high, nulls_outside))


def payable_mismatch(tolerance: str = "0", nulls_fail: bool = True) -> Column:
    """payable differs from order amount - coupon + freight by more than ``tolerance``."""
    expected = F.col("order_amount") - F.col("coupon_amount") + F.col("freight_amount")
    fits = F.abs(F.col("payable_amount") - expected) <= F.lit(Decimal(tolerance))
    return ~F.coalesce(fits, F.lit(not nulls_fail))


def rule_business_formula(df: DataFrame, tolerance: str = "0", nulls_fail: bool = True) -> DataFrame:
    return df.filter(payable_mismatch(tolerance, nulls_fail))


def rule_amount(df: DataFrame, or_zero: bool = False) -> DataFrame:
    return df.filter(F.col("payable_amount") <= 0 if or_zero else F.col("payable_amount") < 0)


def expected_actual() -> Column:
    return F.col("quantity") * F.col("unit_price") - F.col("discount_amount")


def detail_mismatch(expected: Column | None = None, tolerance: str = fixed.MONEY_TOLERANCE) -> Column:
    expected = expected_actual() if expected is None else expected
    return F.abs(F.col("actual_amount") - expected) > F.lit(Decimal(tolerance))


def detail_formula(detail: DataFrame, expected: Column | None = None) -> DataFrame:
    return detail.filter(detail_mismatch(expected))


def price_sanity(product: DataFrame) -> DataFrame:
    return product.agg(
        count_if(F.col("unit_price") < 0).alias("negative_price"),
        count_if(F.col("cost_price") < 0).alias("negative_cost"),
        count_if(F.col("cost_price") > F.col("unit_price")).alias("cost_above_price"),
    )


def key_blank_check(df: DataFrame, columns) -> DataFrame:
    one = df.agg(*[count_if(is_blank(c)).alias(c) for c in columns])
    return to_rows(one, {c: F.col(c) for c in columns}, "column_name", "blank_rows")


def type_errors(df: DataFrame, declared: dict[str, str]) -> dict[str, Column]:
    """Per declared column an aggregate: values outside the family.

    A missing column, or a text column declared over a non-text one, is one error.
    """
    kinds = dict(df.dtypes)
    out = {}
    for name, family in declared.items():
        if name not in kinds:
            out[name] = F.max(F.lit(1)).cast("bigint")
        elif family == "string":
            out[name] = F.max(F.lit(0 if kinds[name] == "string" else 1)).cast("bigint")
        elif kinds[name] == "string":
            c = F.col(name)
            out[name] = count_if(c.isNotNull() & F.trim(c).try_cast("double").isNull())
        else:
            numeric = kinds[name].startswith(("decimal", "int", "bigint", "double", "float", "smallint", "tinyint"))
            out[name] = F.max(F.lit(0 if numeric else 1)).cast("bigint")
    return {k: F.coalesce(v, F.lit(0)) for k, v in out.items()}


def rule_type(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    errors = type_errors(df, declared)
    one = df.agg(*[v.alias(k) for k, v in errors.items()])
    return to_rows(one, {c: F.col(c) for c in declared}, "field", "bad")


# ---- keys ----------------------------------------------------------------


def rule_duplicate(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once.

    Repeated keys are counted first and rows then filtered by a semi join, so
    the rows of a heavily repeated key stay spread over tasks. NULL keys are
    equal to each other.
    """
    repeated = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > 1)
        .select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    )
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(repeated, same, "left_semi")


def pk_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first per key, and the number of repeated keys."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"),
            count_if(F.col("n") > 1).alias("duplicate_keys"),
        )
    )


def rule_count(df: DataFrame, minimum: int = fixed.MIN_ORDER_ROWS) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit("CountRule").alias("rule_name"),
        F.when(F.col("row_count") < minimum, "FAILED").otherwise("SUCCESS").alias("status"),
        F.when(F.col("row_count") < minimum, 1).otherwise(0).cast("bigint").alias("error_count"),
        "row_count",
    )


# ---- rule report, score, error rows --------------------------------------


@dataclass(frozen=True)
class RuleSet:
    """What the order rules need to know about the table."""

    keys: list[str]
    declared: dict[str, str]
    null_columns: list[str] = field(default_factory=list)
    minimum_rows: int = fixed.MIN_ORDER_ROWS
    tolerance: str = "0"


def _choice(rule: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(rule == name, F.lit(value)).otherwise(out)
    return out


def severity(rule: Column) -> Column:
    return _choice(rule, fixed.RULE_SEVERITY, fixed.DEFAULT_SEVERITY)


def rule_suite(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Every rule in one pass: one row per rule.

    Counts are kept per key first, which the duplicate rule needs anyway; the
    other rules add up from the same grouped rows.
    """
    types = type_errors(df, rules.declared)
    per_key = df.groupBy(*rules.keys).agg(
        F.count(F.lit(1)).alias("__n"),
        count_if(any_null(rules.null_columns or df.columns)).alias("__null"),
        count_if(payable_mismatch(rules.tolerance)).alias("__business"),
        count_if(F.col("payable_amount") < 0).alias("__amount"),
        *[v.alias(f"__type_{k}") for k, v in types.items()],
    )
    bad_fields = [F.when(F.coalesce(F.sum(f"__type_{k}"), F.lit(0)) > 0, 1).otherwise(0) for k in types]
    one = per_key.agg(
        F.coalesce(F.sum("__null"), F.lit(0)).alias("NullRule"),
        F.coalesce(F.sum(F.when(F.col("__n") > 1, F.col("__n"))), F.lit(0)).alias("DuplicateRule"),
        sum(bad_fields, F.lit(0)).cast("bigint").alias("TypeRule"),
        F.coalesce(F.sum("__business"), F.lit(0)).alias("BusinessRule"),
        F.coalesce(F.sum("__amount"), F.lit(0)).alias("AmountRule"),
        F.when(F.coalesce(F.sum("__n"), F.lit(0)) < rules.minimum_rows, 1)
        .otherwise(0)
        .cast("bigint")
        .alias("CountRule"),
    )
    rows = to_rows(one, {r: F.col(r) for r in fixed.RULE_MESSAGES}, "rule_name", "error_count")
    failed = F.col("error_count") > 0
    name = F.col("rule_name")
    return rows.select(
        "rule_name",
        F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"),
        "error_count",
        severity(name).alias("severity"),
        F.when(failed, _choice(name, {k: v[0] for k, v in fixed.RULE_MESSAGES.items()}, ""))
        .otherwise(_choice(name, {k: v[1] for k, v in fixed.RULE_MESSAGES.items()}, ""))
        .alias("message"),
    )


def score_detail(results: DataFrame) -> DataFrame:
    """Per rule: weight and what is left of it after 0.1 per error."""
    weight = _choice(F.col("rule_name"), fixed.RULE_WEIGHTS, 0).cast("decimal(18,2)")
    penalty = F.col("error_count") * F.lit(Decimal(fixed.PENALTY_PER_ERROR))
    left = F.greatest(F.lit(Decimal("0.00")), weight - penalty)
    return results.select(
        "rule_name",
        F.when(F.col("status") == "SUCCESS", weight).otherwise(left).cast("decimal(18,2)").alias("score"),
        weight.alias("weight"),
        "status",
        "error_count",
        "severity",
    )


def quality_score(results: DataFrame) -> DataFrame:
    """100 minus the weight lost by all rules, and its level."""
    total = F.lit(Decimal(100)) - F.coalesce(F.sum(F.col("weight") - F.col("score")), F.lit(0))
    level = F.lit(None).cast("string")
    for name, floor in fixed.QUALITY_LEVELS:
        level = F.coalesce(level, F.when(F.col("total_score") >= floor, F.lit(name)))
    return (
        score_detail(results)
        .agg(total.cast("decimal(18,2)").alias("total_score"))
        .withColumn("level", F.coalesce(level, F.lit(fixed.QUALITY_REST)))
    )


def error_rows(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Failing rows of all rules, one row per (row, failed rule)."""
    checks = {
        "NullRule": any_null(rules.null_columns or df.columns),
        "BusinessRule": payable_mismatch(rules.tolerance),
        "AmountRule": F.coalesce(F.col("payable_amount") < 0, F.lit(False)),
    }
    failed = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    by_row = df.select("*", F.explode(failed).alias("rule_name"))
    by_key = rule_duplicate(df, rules.keys).withColumn("rule_name", F.lit("DuplicateRule"))
    both = by_row.unionByName(by_key, allowMissingColumns=True)
    return both.withColumn("severity", severity(F.col("rule_name")))


# ---- relations -----------------------------------------------------------


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_is_many: bool = False) -> DataFrame:
    """Child rows whose key is not in the parent; a NULL key is an orphan too.

    With one parent row per key the parent is joined as it is, so a hot key
    among the children can be split. ``parent_is_many`` (orders looked up in
    their details) removes repeated parent keys first instead.
    """
    keys = parent.select(key)
    return child.join(keys.distinct() if parent_is_many else keys, key, "left_anti")


def orphan_count(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Only keys are read, and counted per key before they meet the parent."""
    keys = child.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return keys.join(parent.select(key).distinct(), key, "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_keys")
    ).select(F.lit(name).alias("relation"), "orphan_rows", "orphan_keys")


def relation_checks(order: DataFrame, detail: DataFrame, customer: DataFrame, product: DataFrame) -> DataFrame:
    """The four relations of the typed tables."""
    parts = [
        orphan_count(detail, order, "order_id", "detail_without_order"),
        orphan_count(order, customer, "customer_id", "order_without_customer"),
        orphan_count(detail, product, "product_id", "detail_without_product"),
        orphan_count(order, detail, "order_id", "order_without_detail"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def order_times(order: DataFrame) -> DataFrame:
    """Earliest time per order id, so a repeated order does not repeat its details."""
    known = order.filter(F.col("order_id").isNotNull())
    return known.groupBy(F.col("order_id").alias("t_order_id")).agg(F.min("order_time").alias("order_time"))


def known_keys(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).select(F.col(key).alias(name)).distinct()


def detail_time_order(detail: DataFrame, order: DataFrame) -> DataFrame:
    """Details created before their order."""
    return (
        detail.join(order_times(order), meets("order_id", "t_order_id"))
        .filter(F.col("created_at") < F.col("order_time"))
        .drop("t_order_id")
    )


def header_detail_reconcile(wide: DataFrame, tolerance: str = fixed.MONEY_TOLERANCE) -> DataFrame:
    """Per order: header amounts, detail sum, formula, differences, match flags."""
    columns = ("order_amount", "coupon_amount", "freight_amount", "payable_amount")
    limit = F.lit(Decimal(tolerance))
    zero = F.lit(Decimal("0.00"))
    # The details of an order repeat its amounts; fixed-width minima are a hash aggregate.
    grouped = wide.groupBy("order_id").agg(
        *[F.min(c).alias(c) for c in columns],
        F.coalesce(F.sum("actual_amount"), zero).alias("detail_amount"),
        F.count(F.lit(1)).alias("detail_count"),
    )
    filled = grouped.select(
        "order_id",
        *[F.coalesce(F.col(c), zero).alias(c) for c in columns],
        "detail_amount",
        "detail_count",
    )
    calculated = F.col("order_amount") - F.col("coupon_amount") + F.col("freight_amount")
    return (
        filled.withColumns(
            {
                "order_amount_difference": F.abs(F.col("detail_amount") - F.col("order_amount")),
                "calculated_payable_amount": calculated,
                "payable_difference": F.abs(calculated - F.col("payable_amount")),
            }
        )
        .withColumns(
            {
                "order_amount_match": F.col("order_amount_difference") <= limit,
                "payable_match": F.col("payable_difference") <= limit,
            }
        )
    )


def reconcile_totals(reconciled: DataFrame) -> DataFrame:
    sums = ("detail_amount", "order_amount", "coupon_amount", "freight_amount", "payable_amount")
    return reconciled.agg(
        F.count(F.lit(1)).alias("order_count"),
        count_if(F.col("order_amount_match")).alias("order_amount_matches"),
        count_if(F.col("payable_match")).alias("payable_matches"),
        count_if(~(F.col("order_amount_match") & F.col("payable_match"))).alias("error_orders"),
        *[F.sum(c).cast("decimal(38,2)").alias(f"{c}_total") for c in sums],
    )


def reconcile_errors(reconciled: DataFrame) -> DataFrame:
    return reconciled.filter(~(F.col("order_amount_match") & F.col("payable_match")))


def integrity_suite(
    order: DataFrame,
    detail: DataFrame,
    customer: DataFrame,
    product: DataFrame,
    expected: Column | None = None,
    quantity_range=fixed.QUANTITY_RANGE,
) -> DataFrame:
    """All clean-data rules: keys, relations, quantity, amounts, time order.

    One pass over the four tables lists every key with its domain, as a parent
    (the table's own key) or as a child (a reference to it), and with the row's
    faults; grouped by domain and key it holds the key, relation and row rules
    together. A second pass over the details meets their orders' times and leaves
    one written row per order, from which time and amount rules and lost orders are read.
    """
    nothing, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    flags = ("quantity", "formula", "payable")

    def keys(df: DataFrame, own: tuple[str, str], references: tuple[str, ...] = (), **faults: Column) -> DataFrame:
        found = {f: F.when(faults[f], one).otherwise(nothing) if f in faults else nothing for f in flags}

        def entry(domain: str, key: str, parent: Column, child: Column, at: dict[str, Column]) -> Column:
            return F.struct(
                F.lit(domain).alias("domain"), F.col(key).cast("string").alias("key"), parent.alias("parent"), child.alias("child"),
                *[at[f].alias(f) for f in flags],
            )

        entries = [entry(*own, one, nothing, found)]
        entries += [entry(r, f"{r}_id", nothing, one, dict.fromkeys(flags, nothing)) for r in references]
        return df.select(F.inline(F.array(*entries)))

    listed = (
        keys(detail, ("order_detail", "order_detail_id"), ("product",),
             quantity=outside_range("quantity", *quantity_range), formula=detail_mismatch(expected))
        .union(keys(order, ("order", "order_id"), ("customer",), payable=payable_mismatch(fixed.MONEY_TOLERANCE)))
        .union(keys(customer, ("customer", "customer_id")))
        .union(keys(product, ("product", "product_id")))
    )
    per_key = listed.groupBy("domain", "key").agg(*[F.sum(c).alias(c) for c in ("parent", "child", *flags)])

    def total(domain: str | None, errors: Column) -> Column:
        at = errors if domain is None else F.when(F.col("domain") == domain, errors)
        return F.coalesce(F.sum(at), nothing)

    repeated = F.when(F.col("key").isNull(), F.col("parent")).otherwise(F.greatest(F.col("parent") - 1, nothing))
    lost = F.when(F.col("key").isNull() | (F.col("parent") == 0), F.col("child")).otherwise(nothing)
    rules = {
        "order_key": total("order", repeated),
        "order_detail_key": total("order_detail", repeated),
        "customer_key": total("customer", repeated),
        "product_key": total("product", repeated),
        "order_customer": total("customer", lost),
        "detail_product": total("product", lost),
        "quantity_range": total(None, F.col("quantity")),
        "actual_amount_formula": total(None, F.col("formula")),
        "payable_formula": total(None, F.col("payable")),
    }
    by_key = per_key.agg(*[c.alias(n) for n, c in rules.items()])

    timed = detail.select("order_id", "actual_amount", "created_at").join(order_times(order), meets("order_id", "t_order_id"), "left")
    per_order = stage(
        timed.groupBy(F.col("order_id").alias("s_order_id")).agg(
            F.sum("actual_amount").alias("detail_amount"),
            count_if(F.col("created_at") < F.col("order_time")).alias("late"),
            count_if(F.col("t_order_id").isNull()).alias("lost"),
        ),
        "order-sums",
    )
    header = order.select("order_id", "order_amount").join(per_order, meets("order_id", "s_order_id"), "left")
    close = F.abs(F.col("order_amount") - F.col("detail_amount")) <= F.lit(Decimal(fixed.MONEY_TOLERANCE))
    by_order = beside(
        header.agg(count_if(~F.coalesce(close, F.lit(False))).alias("order_amount_sum")),
        per_order.agg(*[F.coalesce(F.sum(c), nothing).alias(n) for c, n in (("late", "detail_time"), ("lost", "detail_order"))]),
    )
    parts = [to_rows(df, {n: F.col(n) for n in df.columns}, "rule", "errors") for df in (by_key, by_order)]
    return parts[0].unionByName(parts[1])


# ---- fixed values: the ten documented faults -----------------------------
FAULT_NOTES = {
    "QUANTITY_RANGE": "商品数量超出1至5",
    "DETAIL_AMOUNT_FORMULA": "明细金额不等于数量乘单价减优惠",
    "PRODUCT_FK": "商品主数据不存在",
    "DETAIL_TIME": "明细时间早于订单时间",
    "CUSTOMER_FK": "客户主数据不存在",
    "ORDER_AMOUNT_FORMULA": "应付金额公式异常",
    "ORDER_STATUS_ENUM": "订单状态不在标准枚举中",
    "CUSTOMER_NAME_NULL": "客户名称为空",
    "CATEGORY_NULL": "商品分类为空",
    "DUPLICATE_ROW": {"order": "订单整行重复", "order_detail": "订单明细整行重复"},
}


def anomaly_manifest(
    order: DataFrame,
    detail: DataFrame,
    customer: DataFrame,
    product: DataFrame,
    statuses=fixed.ORDER_STATUSES,
    expected: Column | None = None,
    quantity_range=fixed.QUANTITY_RANGE,
) -> DataFrame:
    """The ten documented faults, found by rule.

    One row per failing row and rule: dataset, row_id, rule_code, field, value,
    description, occurrences. Copies of a duplicated row are one line whose
    ``occurrences`` is the number of extra copies.
    """

    def found(df: DataFrame, dataset: str, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
        # field "all" is the whole row
        hits = [
            F.when(
                bad,
                F.struct(
                    F.lit(code).alias("rule_code"),
                    F.lit(name).alias("field"),
                    F.col(name).cast("string").alias("value"),
                    F.lit(FAULT_NOTES[code]).alias("description"),
                ),
            )
            for code, name, bad in rules
        ]
        return df.select(
            F.lit(dataset).alias("dataset"),
            F.col(key).cast("string").alias("row_id"),
            F.inline(F.array_compact(F.array(*hits))),
        ).withColumn("occurrences", F.lit(1).cast("bigint"))

    def copies(df: DataFrame, dataset: str, key: str) -> DataFrame:
        # Copies share their key and 128 bits of their whole rows' hash; only those are grouped, in one pass.
        whole = [F.xxhash64(F.lit(seed), *[F.struct(F.col(c).isNull(), F.col(c)) for c in df.columns]).alias(f"__h{seed}") for seed in (1, 2)]
        return (
            df.select(key, *whole)
            .groupBy(key, "__h1", "__h2")
            .agg(F.count(F.lit(1)).alias("__n"))
            .filter(F.col("__n") > 1)
            .select(
                F.lit(dataset).alias("dataset"),
                F.col(key).cast("string").alias("row_id"),
                F.lit("DUPLICATE_ROW").alias("rule_code"),
                F.lit("all").alias("field"),
                F.lit("duplicate").alias("value"),
                F.lit(FAULT_NOTES["DUPLICATE_ROW"][dataset]).alias("description"),
                (F.col("__n") - 1).alias("occurrences"),
            )
        )

    product_keys = known_keys(product, "product_id", "k_product_id")
    customer_keys = known_keys(customer, "customer_id", "k_customer_id")
    details = detail.join(order_times(order), meets("order_id", "t_order_id"), "left").join(
        product_keys, meets("product_id", "k_product_id"), "left"
    )
    orders = order.join(customer_keys, meets("customer_id", "k_customer_id"), "left")
    parts = [
        found(
            details,
            "order_detail",
            "order_detail_id",
            [
                ("QUANTITY_RANGE", "quantity", outside_range("quantity", *quantity_range)),
                ("DETAIL_AMOUNT_FORMULA", "actual_amount", detail_mismatch(expected)),
                ("PRODUCT_FK", "product_id", F.col("k_product_id").isNull()),
                ("DETAIL_TIME", "created_at", F.col("created_at") < F.col("order_time")),
            ],
        ),
        found(
            orders,
            "order",
            "order_id",
            [
                ("CUSTOMER_FK", "customer_id", F.col("k_customer_id").isNull()),
                ("ORDER_AMOUNT_FORMULA", "payable_amount", payable_mismatch(fixed.MONEY_TOLERANCE)),
                ("ORDER_STATUS_ENUM", "order_status", outside_set("order_status", statuses)),
            ],
        ),
        found(customer, "customer", "customer_id", [("CUSTOMER_NAME_NULL", "customer_name", F.col("customer_name").isNull())]),
        found(product, "product", "product_id", [("CATEGORY_NULL", "category_name", F.col("category_name").isNull())]),
        copies(order, "order", "order_id"),
        copies(detail, "order_detail", "order_detail_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
