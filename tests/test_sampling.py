import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkgauge.operators import ordering, sampling


def h(key, seed):
    return hashlib.md5(f"{key}:{seed}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, 1 if rng.random() < 0.9 else 0) for i in range(5000)]
    return data, spark.createDataFrame(data, "doc_id bigint, label int").repartition(7)


def test_sample_is_exact_and_is_the_smallest_draws(rows):
    data, df = rows
    got = sampling.sample_per_label(df, 200, 9).collect()
    for label in (0, 1):
        want = sorted((i for i, y in data if y == label), key=lambda i: (h(i, 9), i))[:200]
        assert sorted(r["doc_id"] for r in got if r["label"] == label) == sorted(want)


def test_sample_larger_than_a_label_keeps_all(rows):
    data, df = rows
    got = Counter(r["label"] for r in sampling.sample_per_label(df, 4000, 9).collect())
    assert got == {1: 4000, 0: sum(y == 0 for _i, y in data)}


def test_sample_with_replacement(rows):
    _data, df = rows
    got = sampling.sample_per_label_replace(df, 300, 3).collect()
    assert Counter(r["label"] for r in got) == {0: 300, 1: 300}
    assert len({(r["label"], r["draw_no"]) for r in got}) == 600


def test_splits_are_disjoint_and_complete(rows):
    data, df = rows
    got = sampling.split(df, [0.7, 0.15, 0.15], 4, names=["a", "b", "c"]).collect()
    assert len(got) == len(data) == len({r["doc_id"] for r in got})
    assert Counter(r["part"] for r in got) == {"a": 3500, "b": 750, "c": 750}
    with pytest.raises(ValueError):
        sampling.split(df, [0.5, 0.4], 4)


def test_permutation_matches_the_sorted_draws(rows):
    data, df = rows
    got = sorted((r["position"], r["doc_id"]) for r in sampling.permutation(df, 2).collect())
    assert [i for _p, i in got] == sorted((i for i, _y in data), key=lambda i: (h(i, 2), i))
    assert [p for p, _i in got] == list(range(1, len(data) + 1))


def test_ranks_within_hot_groups(spark, rows):
    data, df = rows
    got = ordering.ranked(df, ["doc_id"], ["label"]).collect()
    for label in (0, 1):
        ids = [i for i, y in data if y == label]
        assert {r["doc_id"]: r["rank"] for r in got if r["label"] == label} == {i: n for n, i in enumerate(sorted(ids), 1)}


def test_running_sums(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("k"), (F.col("id") % 5).alias("v"))
    total, want = 0, {}
    for k, v in sorted((i * 7919 % 3001, i % 5) for i in range(3000)):
        total += v
        want[k] = total
    got = ordering.running_sums(df, ["k"], {"s": "v"}).collect()
    assert {r["k"]: r["s"] for r in got} == want


def test_empty_input(spark):
    df = spark.createDataFrame([], "doc_id bigint, label int")
    assert ordering.ranked(df, ["doc_id"]).count() == 0
    assert sampling.sample_per_label(df, 5, 1).count() == 0


def test_ranks_split_a_hot_value_by_the_further_keys(spark):
    df = spark.range(6000).select(
        F.col("id"), F.when(F.col("id") % 3 != 0, 7).when(F.col("id") % 30 == 0, F.lit(None)).otherwise(F.col("id") % 100).cast("int").alias("v")
    )
    rows = [(i, 7 if i % 3 else (None if i % 30 == 0 else i % 100)) for i in range(6000)]
    want = {i: n for n, (i, _v) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])), 1)}
    for ranges in (64, 400):
        out = ordering.ranked(df, ["v", "id"], out="r", ranges=ranges)
        assert {r["id"]: r["r"] for r in out.collect()} == want
    spread = ordering.with_range(df, ["v", "id"]).where("v = 7").groupBy("_rng").count().collect()
    assert len(spread) > 20 and max(r["count"] for r in spread) < 1000


@pytest.mark.parametrize("rows_of_a_bucket", [3, 40])
def test_large_buckets_are_divided_by_further_digits(spark, monkeypatch, rows_of_a_bucket):
    from inkgauge.functions.base import draw_hex

    monkeypatch.setattr(ordering, "BUCKET_ROWS", rows_of_a_bucket)
    monkeypatch.setattr(ordering, "DRAW_DIGITS", 1)
    df = spark.range(1500).select(F.col("id").alias("doc_id"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    order = {}
    for r in df.select("doc_id", "label", draw_hex("doc_id", 5).alias("h")).collect():
        order.setdefault(r.label, []).append((r.h, r.doc_id))
    order = {k: sorted(v) for k, v in order.items()}
    asked = [(k, c, at) for k in (0, 1) for c, at in enumerate([1, 2, 17, 100, 214, 215, 700, 1285, 5000])]
    wanted = spark.createDataFrame(asked, "label int, cut int, _at bigint")
    got = {(r.label, r.cut): r.doc_id for r in ordering.draw_cuts(df, "doc_id", 5, wanted, ["label"]).collect()}
    assert got == {(k, c): order[k][min(at, len(order[k])) - 1][1] for k, c, at in asked}
    every = sorted(x for v in order.values() for x in v)
    whole = ordering.draw_cuts_of_whole(df, "doc_id", 5, lambda total: [1, 2, total // 2, total, total + 9])
    assert [r.doc_id for r in whole] == [every[at - 1][1] for at in (1, 2, 750, 1500, 1500)]
    assert ordering.draw_cuts_of_whole(df.limit(0), "doc_id", 5, lambda total: [1]) == []
    assert sampling.sample_rows(df, 0, 5).count() == 0 and sampling.sample_rows(df, 9999, 5).count() == 1500
    ranks = {r.doc_id: r["rank"] for r in ordering.draw_ranked(df, "doc_id", 5, ["label"]).collect()}
    assert ranks == {i: n + 1 for v in order.values() for n, (_, i) in enumerate(v)}


def test_ranges_follow_the_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3000")
    try:
        df = spark.range(40_000).select("id", (F.col("id") * 7919 % 40_009).alias("v"))
        assert ordering.default_ranges(df) == 3000
        ranged = ordering.with_range(df, ["v"])
        spark.conf.set("spark.sql.shuffle.partitions", before)
        sizes = ranged.groupBy("_rng").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("z")).orderBy("_rng").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(sizes) > 900 and max(r.n for r in sizes) < 400
    assert all(x.z < y.a for x, y in zip(sizes, sizes[1:]))
