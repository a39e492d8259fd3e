"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martloom.llm.bpe import stage_encode
from martloom.llm.common import settle, table
from martloom.llm.fertility import stage_quality
from martloom.llm.line_dedup import stage_line_dedup
from martloom.llm.mixing import stage_mix
from martloom.llm.simhash import stage_near_dedup
from martloom.session import scratch_step, stage


def _step(number: int, step):
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        # What earlier stages staged is not needed once this one reads their result.
        with scratch_step(settle(spark), number):
            return step(spark, docs, sf_dir)

    run_step.__doc__ = step.__doc__
    return run_step


STAGES = [
    ("quality rules", _step(1, stage_quality)),
    ("line dedup", _step(2, stage_line_dedup)),
    ("near-dedup", _step(3, stage_near_dedup)),
    ("mixing", _step(4, stage_mix)),
    ("encoding", _step(5, stage_encode)),
]

#: SQL can express neither the tokenisers' measures nor fingerprints and ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
