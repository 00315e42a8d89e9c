"""Registered queries next to their SQL."""

import pytest

from inkgauge.llm.queries import ORACLES, QUERIES
from suite.check import close, connect, plain

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SMALL)
    found = connect(SMALL).execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    a = sorted([[plain(r[c]) for c in order] for r in got.collect()], key=str)
    b = sorted([[plain(dict(zip(columns, r))[c]) for c in order] for r in found.fetchall()], key=str)
    assert len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
