"""Load one month of the wide table into the month-partitioned table, or merge corrections into it.

    python -m martloom.plans.month_load WIDE_TABLE MONTH_TABLE 2025-01
    python -m martloom.plans.month_load DELTA_TABLE MONTH_TABLE --upsert order_detail_id
"""

from __future__ import annotations

import sys

from martloom.session import job_session, scratch_scope
from martloom.sources.partitions import check_month, incremental_month_job, upsert_months


def main(argv: list[str]) -> int:
    if len(argv) == 4 and argv[2] == "--upsert":
        spark = job_session()
        with scratch_scope(spark):
            upsert_months(spark.read.parquet(argv[0]), argv[1], argv[3]).show(truncate=False)
        return 0
    if len(argv) != 3:
        print(__doc__)
        return 2
    wide_path, target, month = argv
    try:
        check_month(month)
    except ValueError as e:
        print(e)
        return 2
    spark = job_session()
    incremental_month_job(spark.read.parquet(wide_path), month, target).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
