import datetime as dt

import pytest
from pyspark.sql import functions as F

from inkgauge.operators import config as C
from inkgauge.operators import histograms as H
from inkgauge.operators import routing
from inkgauge.operators.frame import natural_version_sort, select_logged_keys
from inkgauge.functions import urls
from inkgauge.session import fresh_path
from inkgauge.sources import stats, tables
from inkgauge.streaming import metrics as M
from inkgauge.streaming import requests as Q
from inkgauge.streaming import versions as V


def test_values_go_to_the_first_bound_and_overflow_to_infinity(spark):
    df = spark.createDataFrame([("u", v) for v in (0.004, 0.005, 0.0051, 5.0, 9.0)], "url string, latency double")
    got = {r["le"]: (r["n"], r["total"]) for r in H.latency_histogram(df).collect()}
    assert got[0.005] == (2, 5) and got[0.01] == (1, 5) and got[5.0] == (1, 5) and got[H.INF] == (1, 5) and got[2.5] == (0, 5)


def test_list_values_count_each_element(spark):
    df = spark.createDataFrame([("u", [1.0, 2.0, 50.0])], "url string, value array<double>")
    got = {r["le"]: r["n"] for r in H.scalar_histogram(H.observations(df, "value"), [1, 10]).collect()}
    assert got == {1.0: 1, 10.0: 1, H.INF: 1}


def test_unknown_enum_values(spark):
    df = spark.createDataFrame([("u", "cat"), ("u", "cow"), ("u", None)], "url string, value string")
    got = {r["enum"]: (r["n"], r["total"], r["unknown"]) for r in H.enum_histogram(df, ["cat", "dog"]).collect()}
    assert got == {"cat": (1, 2, 1), "dog": (0, 2, 1)}
    for bad in (["b", "a"], ["a"]):
        with pytest.raises(ValueError):
            H.enum_histogram(df, bad)


@pytest.mark.parametrize("freq, n", [(0.4, 2), (1.0, 1), (2.0, 0), (0.3, 3), (0.0, None)])
def test_scaled_counts(one, freq, n):
    assert one(H.scaled_count(F.lit(freq))) == n


def test_sampling_frequencies(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    counts = [Q.sample_stream(df, F.lit(f), "k", 1).count() for f in (0.0, 0.4, 1.0, 2.0)]
    assert counts[0] == 0 and counts[2] == counts[3] == 2000 and abs(counts[1] - 800) < 100


def test_shares_sum_to_hundred(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, m % 3, m % 60), "u", m / 10) for m in range(90)]
    df = spark.createDataFrame(rows, "ts timestamp, url string, v double")
    out = H.bucket_share_over_time(df, H.first_bound("v", [1, 2, 5])).groupBy("window_start").agg(F.sum("share").alias("s"))
    assert [round(r["s"], 9) for r in out.collect()] == [100.0] * 3


def test_names_urls_and_specs(one):
    assert one(urls.metric_name(F.lit("a/b#1"), F.lit("x (y)"))) == "a_b_1:x_(y)"
    assert one(urls.normalize_url(F.lit("a//"), F.lit(None).cast("string"))) == "a"
    assert one(urls.normalize_url(F.lit("a/"), F.lit("1"))) == "a/1"
    assert one(urls.parse_bucket_spec(F.lit("x=0, 1,bad")))["buckets"] == [0.0, 1.0, None]
    assert one(urls.parse_bucket_spec(F.lit("x=0/1/0.25")))["buckets"] == [0.0, 0.25, 0.5, 0.75]
    assert one(urls.parse_enum_spec(F.lit("d=cat, dog")))["buckets"] == ["cat", "dog"]


def test_response_overrides_request(one):
    req = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"), F.lit("z"), F.lit("0"))
    res = F.create_map(F.lit("b"), F.lit("3"))
    assert one(select_logged_keys(req, res, F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == {"a": "1", "b": "3"}


def test_exact_beats_wildcard_and_first_wildcard_wins(spark):
    eps = spark.createDataFrame([("model/1",), ("model/2",), ("other",)], "url string")
    cfg = spark.createDataFrame([("model/*", 1), ("mod*", 0), ("model/2", 9)], "name string, ord int")
    got = {r["url"]: r["name"] for r in C.match_prefix_config(eps, cfg).collect()}
    assert got == {"model/1": "mod*", "model/2": "model/2"}


def test_version_nine_sorts_below_ten(spark):
    df = spark.createDataFrame([("m/9",), ("m/10",), ("m/1",)], "url string")
    assert [r["url"] for r in natural_version_sort(df).collect()] == ["m/10", "m/9", "m/1"]


def test_canary_shares_and_missing_targets(spark):
    canary = spark.createDataFrame([("c", 1, "c/1", 3.0), ("c", 2, "gone", 5.0), ("c", 3, "c/2", 1.0)], "endpoint string, ord int, target string, weight double")
    live = spark.createDataFrame([("c/1",), ("c/2",)], "url string")
    targets = routing.existing_targets(canary, live)
    assert {r["target"]: r["weight"] for r in targets.collect()} == {"c/1": 0.75, "c/2": 0.25}
    reqs = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "c").otherwise("d").alias("url"))
    got = {r["routed"]: r["count"] for r in routing.route_canary(reqs, targets, 5, "id").groupBy("routed").count().collect()}
    assert got["d"] == 2000 and abs(got["c/1"] - 1500) < 100 and got["c/1"] + got["c/2"] == 2000


def test_metric_text_lines(spark):
    lines = ['# HELP x', '', 'lat{model="m",version="1"} 2.5', 'lat{gpu_uuid="g",model="m",version="2"} 3', 'lat 4', 'lat{model="m",version="1"} ..']
    got = tables.scan_metrics_text(spark.createDataFrame([(v,) for v in lines], "value string")).collect()
    assert sorted((r["series"], r["value"]) for r in got) == [("m.v1", 2.5), ("m.v2", 3.0)]


def test_messages_fit_and_are_whole(spark):
    df = spark.range(500).select("id", F.repeat(F.lit("é"), (F.col("id") % 40).cast("int")).alias("t"))
    packed = stats.pack_batches(df, "id", 600, blocks=3).collect()
    assert sum(r["n"] for r in packed) == 500
    for r in packed:
        assert len(r["message"].encode()) == r["bytes"] <= 600
    assert stats.blocks_for(df, block_bytes=1000) > 1


def test_bad_messages_and_events_without_url_are_skipped(spark):
    msgs = ['[{"_url":"a","x":1,"l":[1,2]},{"x":2},{"_url":"","x":3}]', "not json", "[{"]
    rows = stats.event_variables(stats.unpack_events(spark.createDataFrame([(m,) for m in msgs], "value string"))).collect()
    assert sorted((r["url"], r["variable"], r["value"]) for r in rows) == [("a", "l", "1"), ("a", "l", "2"), ("a", "x", "1")]


def test_late_rows_are_dropped(spark):
    path = fresh_path(spark, "late")
    base = dt.datetime(2024, 1, 1)
    schema = "ts timestamp, url string, v double"
    for i, minutes in enumerate([[0, 1], [60], [62], [2, 61], [120]]):
        rows = [(base + dt.timedelta(minutes=m), "u", 1.0) for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/*")
    out = M.run_to_table(M.windowed_rates(files, H.first_bound("v", [5])), "late", mode="append")
    starts = {int((r["window_start"] - base).total_seconds() // 60): r["n"] for r in out.collect()}
    assert starts == {0: 1, 1: 1, 60: 1, 61: 1, 62: 1}


def test_changed_configuration_applies_from_the_next_batch(spark):
    path = fresh_path(spark, "cfg")
    schema = "url string, variable string, value string"
    for i in range(2):
        spark.createDataFrame([("u", "k", "7")] * 3, schema).coalesce(1).write.parquet(f"{path}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    bounds = iter([["5", "10"], ["8", "10"]])

    def config():
        return spark.createDataFrame([("u", "k", "scalar", next(bounds))], "url string, variable string, type string, buckets array<string>")

    got = M.metrics_stream(stream, lambda b: b, config, "reload")
    assert {r["bucket"]: r["n"] for r in got.collect()} == {"10.0": 3, "8.0": 3}


def test_versions_over_two_snapshots(spark):
    path = fresh_path(spark, "snap")
    schema = "base_url string, model_id bigint, updated timestamp"
    day = lambda d: dt.datetime(2024, 1, d)
    spark.createDataFrame([("m", 1, day(1)), ("m", 2, day(2))], schema).coalesce(1).write.parquet(f"{path}/0")
    spark.createDataFrame([("m", 2, day(2)), ("m", 3, day(3)), ("n", 4, day(1))], schema).coalesce(1).write.parquet(f"{path}/1")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    got = {(r["base_url"], r["version"]): r["model_id"] for r in V.version_sync(stream, 2, "snap").collect()}
    assert got == {("m", 2): 2, ("m", 3): 3, ("n", 1): 4}


def test_configuration_differences(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 3, None)], "url string, v int, t string")
    new = spark.createDataFrame([("a", 1, "x"), ("b", 5, "x"), ("d", 1, "x")], "url string, v int, t string")
    assert {r["url"]: r["change"] for r in C.config_changes(old, new, "url").collect()} == {"b": "changed", "c": "removed", "d": "added"}
    assert C.unchanged(old, old.select("url", "t", "v"), "url") and not C.unchanged(old, new, "url")


def test_metric_removal(spark):
    df = spark.createDataFrame([("m/1", {"x": "scalar", "y": "enum"}), ("n", {"x": "value"})], "endpoint string, metrics map<string,string>")
    one = {r["endpoint"]: r["metrics"] for r in C.remove_metric(df, "/m/1/", "x").collect()}
    assert one == {"m/1": {"y": "enum"}, "n": {"x": "value"}}
    assert [r["endpoint"] for r in C.remove_metric(df, "m/1").collect()] == ["n"]


def test_streams_resume_from_a_given_root(spark):
    path, root = fresh_path(spark, "in"), fresh_path(spark, "resume")
    schema = "url string, variable string, value string"
    cfg = spark.createDataFrame([], "url string, variable string, type string, buckets array<string>")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{path}/*")
        out = M.run_to_table(M.running_metrics(stream, cfg), "resume", root=root)
        return {(r["url"], r["variable"]): r["total"] for r in out.collect()}

    spark.createDataFrame([("u", "_count", "2")], schema).write.parquet(f"{path}/0")
    assert run() == {("u", "_count"): 2.0}
    assert run() == {("u", "_count"): 2.0}
    spark.createDataFrame([("u", "_count", "3"), ("u", "other", "1")], schema).write.parquet(f"{path}/1")
    assert run() == {("u", "_count"): 5.0}


def test_repeated_configuration_does_not_multiply_rows(spark):
    stats = spark.createDataFrame([("u", "x", 1.0), ("u", "_latency", 2.0)], "url string, variable string, value double")
    cfg = spark.createDataFrame([("u", "x", "scalar", [2.0]), ("u", "x", "enum", [1.0])], "url string, variable string, type string, buckets array<double>")
    got = C.lookup_metric_config(stats, cfg).collect()
    assert sorted((r["variable"], r["type"]) for r in got) == [("_latency", "scalar"), ("x", "enum")]
    requests = spark.createDataFrame([("u",), ("v",)], "url string")
    models = spark.createDataFrame([("u", "b"), ("u", "a")], "url string, model_id string")
    got = C.resolve_endpoint(requests, models, models).collect()
    assert sorted((r["url"], r["model_id"]) for r in got) == [("u", "a"), ("v", None)]


def test_a_stream_runs_on_until_it_is_stopped(spark, tmp_path):
    import time

    path, root = str(tmp_path / "in"), fresh_path(spark, "running")
    spark.range(3).write.parquet(path)
    stream = spark.readStream.schema("id long").parquet(path).groupBy().count()
    query = M.start_to_table(stream, root, trigger={"processingTime": "100 milliseconds"})

    def wait_for(n):
        end = time.time() + 60
        while time.time() < end:
            rows = M.read_table(spark, root, "count long").collect()
            if rows and rows[0]["count"] == n:
                return True
            time.sleep(0.3)
        return False

    try:
        assert wait_for(3) and query.isActive
        spark.range(4).write.mode("append").parquet(path)
        assert wait_for(7)
    finally:
        query.stop()
    assert M.read_table(spark, fresh_path(spark, "none"), "count long").count() == 0


def test_updates_keep_a_bounded_table_and_resume(spark, tmp_path):
    import os

    M.use_rocksdb(spark)
    root, source = str(tmp_path / "out"), str(tmp_path / "in")
    rows = [(k % 3 if k % 5 else None, k) for k in range(23)]

    def drain(whole_every):
        stream = spark.readStream.schema("k int, v int").option("maxFilesPerTrigger", 1).parquet(source)
        counts = stream.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("v"))
        M.start_updates(counts, root, ["k"], whole_every=whole_every).awaitTermination()
        return counts.schema

    for begin, end in ((0, 14), (14, 23)):
        for r in rows[begin:end]:
            spark.createDataFrame([r], "k int, v int").coalesce(1).write.mode("append").parquet(source)
        schema = drain(4)
        want = {}
        for k, v in rows[:end]:
            n, top = want.get(k, (0, -1))
            want[k] = (n + 1, max(top, v))
        got = M.read_updates(spark, root, schema, ["k"])
        assert got.columns == ["k", "n", "v"] and {r.k: (r.n, r.v) for r in got.collect()} == want
        folders = os.listdir(f"{root}/changes")
        assert len([f for f in folders if f.startswith("batch=")]) <= 8 and len([f for f in folders if f.startswith("whole=")]) <= 2
    assert M.read_updates(spark, str(tmp_path / "none"), schema, ["k"]).count() == 0


def test_old_totals_are_dropped(spark, tmp_path):
    import os

    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(5):
        spark.range(k + 1).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source).groupBy().agg(F.count("*").alias("n"))
    assert M.run_to_table(stream, "old", root=root).first()["n"] == 15
    assert sorted(f for f in os.listdir(f"{root}/out") if f.startswith("batch=")) == ["batch=3", "batch=4"]
