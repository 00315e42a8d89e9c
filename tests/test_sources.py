import os

import pytest
from pyspark.sql import functions as F

from inkgauge.operators import frame as P
from inkgauge.session import fresh_path
from inkgauge.sources import sinks, tables


def test_csv_union_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label\n"one, ""two""\nthree",1\n')
    (tmp_path / "b.csv").write_text("source,text\ns,four\n")
    (tmp_path / "c.csv").write_text("text,label\nfive,0\n")
    got = tables.scan_csv_union(spark, f"{tmp_path}/*.csv", ["text", "label", "source", "prompt"]).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(
        [('one, "two"\nthree', "1", None, None), ("four", None, "s", None), ("five", "0", None, None)], key=str
    )


def test_nulls_go_before_the_cast(spark, tmp_path):
    rows = [("a", "1", "s"), (None, "1", "s"), ("b", None, "s"), ("c", "x", "s")]
    spark.createDataFrame(rows, "text string, label string, source string").write.parquet(f"{tmp_path}/p")
    got = {r["text"]: r["label"] for r in tables.scan_labelled(spark, f"{tmp_path}/p").collect()}
    assert got == {"a": 1, "c": None}


def test_dataset_versions_are_immutable_and_listed(spark):
    root = fresh_path(spark, "ds")
    for n in (3, 5):
        sinks.write_dataset_version(spark.range(n), root, "d", f"{n} rows", ["t"])
    assert sinks.read_dataset_version(spark, root, "d").count() == 5
    assert sinks.read_dataset_version(spark, root, "d", 1).count() == 3
    assert sorted((r["version"], r["description"]) for r in sinks.read_manifest(spark, root).collect()) == [(1, "3 rows"), (2, "5 rows")]
    with pytest.raises(ValueError):
        sinks.read_dataset_version(spark, root, "other")


def test_submission_header(spark):
    path = fresh_path(spark, "sub")
    sinks.write_submission(spark.createDataFrame([(1, 0.5, "x")], "id int, generated double, other string"), path)
    parts = [open(f"{path}/{f}").read() for f in sorted(os.listdir(path)) if f.endswith(".csv")]
    # parts without rows hold the header alone
    assert all(p.startswith("id,generated\n") for p in parts)
    assert "".join(p.removeprefix("id,generated\n") for p in parts) == "1,0.5\n"


def test_prompts_with_nulls(spark):
    df = spark.createDataFrame([("p", "t"), (None, "t")], "prompt string, text string")
    rows = P.build_prompts(df, "S:", "D:", "R:").collect()
    assert [r["standard_prompt"] for r in rows] == ["S:p", None] and rows[1]["rewrite_prompt"] == "R:t"


def test_first_per_group_skips_nulls(spark):
    rows = [(2, "k", None, "b"), (1, "k", "x", None), (3, "k", "y", "c"), (4, None, "z", "z")]
    df = spark.createDataFrame(rows, "ord int, prompt string, a string, b string")
    assert [tuple(r) for r in P.first_per_group(df, "prompt", "ord", ["a", "b"]).collect()] == [("k", "x", "b")]


def test_serving_types():
    schema = tables.tensor_schema(["a", "b"], ["uint64", "float16"], [[], [1, 2]])
    assert schema.simpleString() == "struct<a:decimal(20,0),b:array<array<float>>>"


def test_best_trial_first_wins_ties(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.9)], "trial int, auc double")
    assert P.best_trial(df).first()["trial"] == 1


def test_writers_at_once_take_different_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path)
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda n: sinks.write_dataset_version(spark.range(n), root, "d/x"), range(1, 7)))
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and sinks.read_manifest(spark, root).count() == 6
    assert sorted(sinks.read_dataset_version(spark, root, "d/x", v).count() for v in got) == [1, 2, 3, 4, 5, 6]
    assert [sinks.read_dataset_version(spark, root, "d/x", v).count() for v in got] == [1, 2, 3, 4, 5, 6]


def test_a_lost_write_lists_nothing(spark, tmp_path):
    root = str(tmp_path)
    assert sinks.write_dataset_version(spark.range(3), root, "d") == 1
    with pytest.raises(Exception, match="lost"):
        sinks.write_dataset_version(spark.range(9).select(F.raise_error(F.lit("lost")).alias("x")), root, "d")
    # a log entry that was begun and never ended
    (tmp_path / "manifest" / "d-2.json").write_text('{"name": "d", "ver')
    assert [r["version"] for r in sinks.read_manifest(spark, root).collect()] == [1]
    assert sinks.read_dataset_version(spark, root, "d").count() == 3
    assert sinks.write_dataset_version(spark.range(4), root, "d") == 3
    assert sinks.read_dataset_version(spark, root, "d").count() == 4


def test_prefix_configuration_by_tree_and_by_join(spark, monkeypatch):
    import random

    from inkgauge.operators import config as C
    from inkgauge.operators import routing as R

    rng = random.Random(3)

    def word():
        return "".join(rng.choice("abé/") for _ in range(rng.randint(0, 5)))

    cfg = [(word() + rng.choice(["*", ""]), rng.randint(1, 40), str(i)) for i in range(120)] + [("*", 99, "all"), ("a*", 1, "x"), ("a*", 1, "w")]
    urls = [(word(),) for _ in range(300)] + [(None,)]
    want = {}
    for (u,) in urls:
        if u is None:
            continue
        hits = [(0, o, n, x) for n, o, x in cfg if n == u and not n.endswith("*")] + [(1, o, n, x) for n, o, x in cfg if n.endswith("*") and u.startswith(n[:-1])]
        # of one order the shorter prefix sorts first
        want[u] = min(hits, key=lambda h: (h[0], h[1], h[2].removesuffix("*"), h[3]))[2:]
    frames = spark.createDataFrame(urls, "url string"), spark.createDataFrame(cfg + [(None, 0, "n")], "name string, ord int, more string")
    rows = C.match_prefix_config(*frames)
    assert {r.url: (r.name, r.more) for r in rows.collect()} == want
    assert "Generate" not in rows._jdf.queryExecution().optimizedPlan().toString()
    canary = spark.createDataFrame([("x", "a", [1.0, 2.0]), ("y", "", [1.0]), ("z", "zz", [1.0]), ("n", None, [1.0])], "endpoint string, prefix string, weights array<double>")
    targets = sorted(map(repr, R.rank_prefix_targets(canary, frames[0]).collect()))
    monkeypatch.setattr(C, "small_rows", lambda table: None)
    monkeypatch.setattr(R, "small_rows", lambda table: None)
    assert {r.url: (r.name, r.more) for r in C.match_prefix_config(*frames).collect()} == want
    assert sorted(map(repr, R.rank_prefix_targets(canary, frames[0]).collect())) == targets and len(targets) == 3


def test_many_prefixes_are_one_tree():
    from inkgauge.functions.prefixes import prefix_tree, prefixes_of

    tree = prefix_tree([f"model{i}/" for i in range(100_000)] + ["", "model1"])
    assert list(prefixes_of("model12345/7", tree)) == ["", "model1", "model12345/"] and list(prefixes_of("x", tree)) == [""]
