"""Files and key skew of all tables of a warehouse.

    python -m martloom.plans.layer_audit BASE_FOLDER
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.operators.skew import key_skew_audit
from martloom.plans.store import LayerStore
from martloom.session import job_session
from martloom.sources.layout import file_layout_audit

# ---- fixed values: tables and keys that are audited ----------------------
EXPECTED = (
    "ods_order", "ods_order_detail", "ods_customer", "ods_product", "dwd_order_detail", "dws_user_sales", "dws_product_sales",
    "ads_sales_summary", "fact_order", "fact_order_detail", "dim_customer", "dim_product", "dim_date",
)
SKEW_KEYS = {"dwd_order_detail": ("order_id", "customer_id", "product_id", "receiver_province_name", "order_channel"), "fact_order": ("customer_id", "order_date")}


def files(store: LayerStore) -> DataFrame:
    """One row per table: those expected, there or not, and whatever else is there."""
    return file_layout_audit(store.spark, {t: store.path(t) for t in EXPECTED} | store.tables())


def skew(store: LayerStore) -> DataFrame:
    """One row per audited key of the tables that are there, all keys of a table from one grouping."""
    there = store.tables()
    parts = [
        key_skew_audit(df, [k for k in keys if k in df.columns]).select(F.lit(t).alias("table_name"), "*")
        for t, keys in SKEW_KEYS.items()
        if t in there
        for df in [store.read(t)]
    ]
    if not parts:
        raise FileNotFoundError(f"no table with audited keys below {store.base}")
    return reduce(DataFrame.unionByName, parts)


def main(argv: list[str]) -> int:
    if len(argv) != 1:
        print(__doc__)
        return 2
    store = LayerStore(job_session(), argv[0])
    files(store).show(100, truncate=False)
    skew(store).show(100, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
