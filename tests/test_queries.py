"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    from suite.check import connect

    return connect(SF)


def _names():
    from suite.all import QUERIES

    return list(QUERIES)


@pytest.mark.parametrize("name", _names())
def test_query(spark, con, name):
    from suite.all import ORACLES, QUERIES
    from suite.check import compare

    state, detail = compare(QUERIES[name](spark, SF), con, ORACLES.get(name))
    assert state != "FAIL", detail


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.count() > 0 and "flesch_kincaid_grade" in df.columns
