"""Every registered query against its SQL on the smallest scale factor."""

import re

import pytest

import __spark_entry__ as entry
from check_queries import connect, difference
from supplyloom.catalogue import registry

FOLDER = "/root/testdata/sf0.001"
KEYS = list(registry.QUERIES)


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(KEYS) == set(registry.SQL) and set(KEYS) <= set(entry.queries())
    assert len(KEYS) == 91


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_sql(spark, duck, key):
    df = entry.queries()[key](spark, FOLDER)
    ours = df.toPandas()
    assert difference(ours, duck.execute(entry.oracle_sql()[key]).fetchdf()) is None
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|NestedLoopJoin|BatchEvalPython", text)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "category" in df.columns
