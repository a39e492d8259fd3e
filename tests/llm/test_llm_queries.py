"""All queries of the package: SQL, empty tables, registration."""

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from checks.compare import compare, connect
from martloom.llm.queries import ORACLES
from martloom.llm.queries import QUERIES as OPERATORS
from martloom.session import stage

QUERIES = OPERATORS | {"pipeline": corpus_pipeline.run}


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, folder, key):
    assert compare(spark, connect(folder), folder, QUERIES[key], ORACLES[key]) == ""


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, key):
    found = QUERIES[key](spark, empty_dir).collect()
    assert len(found) == (1 if key == "op3_chat" else 0)  # the chat query has a conversation of its own


def test_registered():
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES if k != "pipeline") == list(range(1, 14))


def test_pipeline_stages(spark, docs, edge_dir):
    current = docs
    sizes = [current.count()]
    for _, step in corpus_pipeline.STAGES[:-1]:
        current = stage(step(spark, current, edge_dir), "step")
        assert current.columns == docs.columns
        sizes.append(current.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2]
    last = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, current, edge_dir).collect()), key=str)
    assert len(last) == sizes[-1]
    assert sorted(map(tuple, corpus_pipeline.run(spark, edge_dir).collect()), key=str) == last
