import math
import random

import pytest
from pyspark.sql import functions as F

from inkgauge.llm import op10_mtree as o


def brute(rows, k, queries):
    dims = {}
    known = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        known.append((i, [math.floor(256 * x) for x in v]))
        dims[len(v)] = dims.get(len(v), 0) + 1
    dim = max(dims, key=lambda d: (dims[d], d), default=0)
    known = [(i, v) for i, v in known if len(v) == dim]
    out = []
    for q, x in known:
        if q in queries:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in known if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("seed,group,page", [(0, 8, 4), (1, 256, 64), (2, 5, 2)])
def test_equals_brute_force(spark, monkeypatch, seed, group, page):
    monkeypatch.setattr(o, "GROUP_LEAST", group)
    monkeypatch.setattr(o, "PAGE_ROWS", page)
    monkeypatch.setattr(o, "TOP_NODES", 6)
    monkeypatch.setattr(o, "QUERY_BLOCK", 4)
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) + (i % 3) for _ in range(4)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [(300, [0.0] * 4), (301, [100.0, -5.0, 2.0, 1.0])]
    rows += [(400, None), (401, []), (402, [1.0, None, 2.0, 3.0]), (403, [float("nan")] * 4), (404, [float("inf"), 0.0, 0.0, 0.0]), (405, [1.0, 2.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, top string")
    queries = {i for i, _ in rows if i is not None and i % 10 == 0}
    got = sorted(tuple(r) for r in o.exact_top_k(df, F.col("vec_id") % 10 == 0).collect())
    assert got == brute(rows, 5, queries)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (50, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in o.exact_top_k(df.limit(0), F.lit(True)).collect()] == []
    assert sorted(tuple(r) for r in o.exact_top_k(df.where("vec_id = 0"), F.lit(True)).collect()) == []
    got = sorted(tuple(r) for r in o.exact_top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (50, [0.5, 0.5])], 5, {0, 50})
