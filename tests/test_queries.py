"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from docweave.plans.registry import QUERIES
from tests.conftest import SMALL
from tests.oracle import compare, connect

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(NAMES) > 90


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "id", "score", "rank"]
    assert df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, sql) is None
