import math

import pytest
from pyspark.sql import functions as F

from inkgauge.llm import op3_mixing as o

from .helpers import odd_documents


def docs_of(spark):
    rows = [(i, "w " * (1 + i % 7)) for i in range(300)] + [(1000, None), (1001, ""), (None, "a b"), (5, "x y z"), (5, "x y z")]
    docs = odd_documents(spark, rows)
    return docs.withColumn("source", F.when(F.col("doc_id") < 240, "big").when(F.col("doc_id") < 290, "mid").when(F.col("doc_id") < 300, "small"))


def test_every_document_is_used_and_limits_hold(spark):
    docs = docs_of(spark)
    rows = o.mix_sources(docs, repeats=3.0, block_tokens=100).collect()
    assert len([r for r in rows if r.epoch == 0]) == docs.count()
    tokens = {}
    for r in rows:
        tokens.setdefault(r.source, {}).setdefault(r.epoch, []).append(r.n_tokens)
    whole = {s: sum(e[0]) for s, e in tokens.items()}
    times = {s: sum(sum(x) for x in e.values()) / whole[s] for s, e in tokens.items()}
    assert max(times.values()) == times[None] == 3.0 and min(times.values()) == times["big"] == 1 < times["mid"] < times["small"]
    again = o.mix_sources(docs.repartition(5), repeats=3.0, block_tokens=100).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_blocks_hold_the_weights(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 5 as int))").alias("text"), F.when(F.col("id") < 3200, "a").otherwise("b").alias("source"))
    rows = o.mix_sources(docs, repeats=2.0, block_tokens=1000).collect()
    blocks = {}
    for r in rows:
        blocks.setdefault(r.block, {}).setdefault(r.source, 0)
        blocks[r.block][r.source] += r.n_tokens
    shares = [b["a"] / sum(b.values()) for k, b in blocks.items() if k < max(blocks) - 1]
    assert max(shares) - min(shares) < 0.03


def test_entropy_target_and_budget(spark):
    sizes = spark.createDataFrame([("a", 10, 700), ("b", 10, 200), ("c", 10, 100), ("d", 2, 0)], "source string, n_docs long, tokens long")
    w = {r.source: r for r in o.source_weights(sizes, entropy=1.0, repeats=None).collect()}
    h = -sum(x.weight * math.log(x.weight) for x in w.values() if x.weight)
    assert h == pytest.approx(1.0, abs=1e-6) and w["d"].weight == 0 and w["d"].quota == 0
    w = {r.source: r for r in o.source_weights(sizes, repeats=1.5, budget=1000).collect()}
    assert max(r.quota / r.tokens for r in w.values() if r.tokens) == pytest.approx(1.5, abs=0.01)
    assert sum(r.quota for r in w.values()) == pytest.approx(1000, abs=2)


def test_empty_and_wordless(spark):
    docs = docs_of(spark)
    assert o.mix_sources(docs.limit(0)).count() == 0
    none = docs.where("doc_id in (1000, 1001)")
    assert sorted((r.id, r.n_tokens, r.epoch) for r in o.mix_sources(none).collect()) == [(1000, 0, 0), (1001, 0, 0)]


def test_no_python_in_the_plan(spark):
    plan = o.mix_sources(docs_of(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_very_long_text_is_one_document(spark):
    rows = [(1, "word " * 200_000), (2, "a b c"), (4, "d e"), (5, None)]
    got = o.mix_sources(odd_documents(spark, rows), block_tokens=100).collect()
    tokens = {r.id: r.n_tokens for r in got}
    assert tokens == {1: 200_000, 2: 3, 4: 2, 5: 0}


def test_a_pass_serves_several_steps_of_the_bisection(spark):
    shares = [0.61, 0.25, 0.1, 0.04]
    sources = spark.createDataFrame([(s,) for s in shares], "share double").coalesce(1)

    def plain(meets):
        low, high = 0.0, 1.0
        for _ in range(o.STEPS):
            middle = (low + high) / 2
            low, high = (low, middle) if meets([s**middle for s in shares]) else (middle, high)
        return high

    sc = spark.sparkContext
    sc.setJobGroup("bisection", "bisection")
    got = o.bisect_exponent(sources, None, 2.0, None, 100)
    jobs = sc.statusTracker().getJobIdsForGroup("bisection")
    sc.setJobGroup("tests", "tests")
    assert len(jobs) <= 2 * (1 + -(-o.STEPS // o.LEVELS))
    assert got == pytest.approx(plain(lambda p: max(x / s for x, s in zip(p, shares)) / min(x / s for x, s in zip(p, shares)) <= 2.0 + 1e-12), abs=1e-10)
    got = o.bisect_exponent(sources, None, 1.5, 130, 100)
    assert got == pytest.approx(plain(lambda p: 130 * max(x / s for x, s in zip(p, shares)) / sum(p) / 100 <= 1.5 + 1e-12), abs=1e-10)
    got = o.bisect_exponent(sources, 0.9, None, None, 100)
    assert got == pytest.approx(plain(lambda p: -sum(x / sum(p) * math.log(x / sum(p)) for x in p) <= 0.9 + 1e-12), abs=1e-9)
    assert o.bisect_exponent(sources, None, 100.0, None, 100) == 0.0 and o.bisect_exponent(sources, 0.01, None, None, 100) == 1.0
