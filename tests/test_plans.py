"""Physical plans: shuffles, broadcasts, pruned scans and hot keys."""

import re

import pytest
from pyspark.sql import functions as F

from inkgauge import session
from inkgauge.functions import text as X
from inkgauge.operators import annotate as A
from inkgauge.operators import config as C
from inkgauge.operators import evaluation as E
from inkgauge.operators import frame as P
from inkgauge.operators import routing, sampling, tokens, versions
from inkgauge.plans.feature_table import cleaned, feature_table, row_features
from inkgauge.plans import scoring
from inkgauge.session import spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|SinglePartition)", plan(df)))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    rows = [(i, f"The Old cat sat. It ran {i} times!", "hot" if i % 3 else f"s{i}", i % 2) for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, label int").write.parquet(path)
    return spark.read.parquet(path)


def test_document_features_need_no_shuffle(docs):
    assert shuffles(row_features(cleaned(docs))) == 0
    assert shuffles(A.annotate(docs)) == 0
    assert shuffles(tokens.sentence_bigrams(A.annotate_sentences(docs))) == 0


def test_scan_reads_only_what_is_used(docs):
    text = plan(row_features(cleaned(docs)))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    filtered = plan(P.filter_label(docs, 1).select("doc_id"))
    assert "EqualTo(label,1)" in filtered and "ReadSchema: struct<doc_id:bigint,label:int>" in filtered


def test_feature_table_is_one_scan_without_a_shuffle(spark, docs):
    lex = spark.createDataFrame([("c", "cat"), ("d", "old")], "category string, token string")
    df = feature_table(docs, lex, lex.select("token"), ["c", "d"])
    text = plan(df)
    # a table of one split is dealt to the cores first, and nothing moves after that
    assert shuffles(df) == text.count("REPARTITION_BY_NUM") <= 1
    assert "Join" not in text and text.count("FileScan") == 1


def test_large_lexicon_is_joined_and_counted_before_the_shuffle(spark, docs):
    lex = spark.createDataFrame([("c", "cat"), ("d", "old")], "category string, token string")
    words = cleaned(docs).select("doc_id", F.explode(F.split(F.lower("clean"), " ")).alias("token"))
    df = tokens.lexicon_counts(words, lex, ["c", "d"])
    text = plan(df)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and shuffles(df) == 2
    assert text.index("partial_count") > text.rindex("Exchange hash")  # printed top down


def test_sampling_and_splitting_do_not_move_the_texts(docs):
    sample = sampling.sample_per_label(docs, 5, 1)
    assert shuffles(sample) == 0 and "BroadcastHashJoin" in plan(sample)
    assert shuffles(sampling.split(docs, [0.7, 0.3], 1)) == 0


def test_routing_and_lookup_keep_requests_in_place(spark):
    reqs = spark.range(100).select("id", F.lit("c").alias("url"))
    targets = spark.createDataFrame([("c", 1, "c/1", 0.5), ("c", 2, "c/2", 0.5)], "endpoint string, ord int, target string, weight double")
    assert shuffles(routing.route_canary(reqs, targets, 1, "id")) == 0
    eps = spark.createDataFrame([("c", "m")], "url string, model_id string")
    assert shuffles(C.resolve_endpoint(reqs, eps, eps)) == 0


def test_one_aggregate_for_all_cells(docs):
    df = docs.select("label", (1 - F.col("label")).alias("prediction"))
    assert shuffles(E.confusion_matrix(df)) == 1
    assert shuffles(E.binary_metrics(df)) == 1


def test_prefix_match_is_a_hash_join(spark):
    eps = spark.range(50).select(F.concat(F.lit("m/"), F.col("id").cast("string")).alias("url"))
    cfg = spark.createDataFrame([("m/*", 1)], "name string, ord int")
    assert "NestedLoop" not in plan(C.match_prefix_config(eps, cfg))


def test_top_k_is_limited_before_the_shuffle(spark):
    models = spark.range(1000).select(F.concat(F.lit("u"), F.col("id") % 2).alias("base_url"), F.col("id").alias("model_id"), F.col("id").alias("updated"))
    text = plan(versions.latest_models(models, 3))
    assert "WindowGroupLimit" in text and "BroadcastHashJoin" in text


def test_hot_keys_keep_every_row(spark):
    """A third of the rows on one key: counts and ranks stay exact."""
    n = 9000
    df = spark.range(n).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("label")
    )
    got = {r["label"]: r["count"] for r in sampling.sample_per_label(df, 100, 1).groupBy("label").count().collect()}
    assert got["hot"] == 100 and sum(got.values()) == sum(min(100, c) for c in _sizes(df).values())
    from inkgauge.operators.ordering import draw_ranked, ranked

    for out in (ranked(df, ["doc_id"], ["label"]), draw_ranked(df, "doc_id", 1, ["label"])):
        tops = {r["label"]: (r["m"], r["c"], r["d"]) for r in out.groupBy("label").agg(F.max("rank").alias("m"), F.count("*").alias("c"), F.countDistinct("rank").alias("d")).collect()}
        assert all(m == c == d for m, c, d in tops.values()) and tops["hot"][0] == n // 3


def _sizes(df):
    return {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}


def test_a_very_long_text_is_measured_whole(spark):
    text = " ".join(f"word{i % 97} the." if i % 50 == 0 else f"word{i % 97}" for i in range(30000))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = df.select(X.text_counts("text").alias("c"), A.syntax_struct(F.col("text")).alias("s")).first()
    assert row["c"]["n_words"] == 30600 and row["s"]["num_tokens"] == 31200
    assert row["s"]["num_sentences"] == 601


def test_a_text_in_many_splits_is_dealt_by_its_key_and_its_tokens_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "many")
    rows = [(i, f"The Old cat sat. It ran {i} times! " * 40) for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # so the files fill the cores with splits
    try:
        dealt = spread(spark.read.parquet(path), "doc_id")
        token_rows = A.annotate(dealt)
        for df in (
            A.token_stats(token_rows), A.entity_stats(token_rows), A.noun_chunk_stats(token_rows), A.pos_distribution(token_rows),
            tokens.token_bigrams(token_rows), A.rule_stats(A.annotate_sentences(dealt)),
            A.token_stats(A.explode_annotations(A.collect_annotations(token_rows))),
        ):
            assert shuffles(df) == plan(df).count("REPARTITION_BY_NUM") == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_dealt_partitions_grow_in_number_with_the_input(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "grown")
    spark.range(2000).selectExpr("id AS doc_id", "md5(string(id)) AS text").write.parquet(path)
    df = spark.read.parquet(path)
    few = spread(df, "doc_id").rdd.getNumPartitions()
    monkeypatch.setattr(session, "SPREAD_MOST", 1000)
    assert few < 20 < spread(df, "doc_id").rdd.getNumPartitions()
    assert spread(df, "doc_id").rdd.getNumPartitions() <= session.SPREAD_TASKS * spark.sparkContext.defaultParallelism
    unknown = spark.createDataFrame(df.rdd, df.schema)
    assert spread(unknown, "doc_id") is unknown


def test_replies_are_scored_from_dealt_texts(spark, docs, monkeypatch):
    asked = []
    monkeypatch.setattr(scoring, "spread", lambda df, key: asked.append(key) or spread(df, key))
    lex = spark.createDataFrame([("c", "cat"), ("d", "old")], "category string, token string")
    vocab = spark.createDataFrame([("cat", 4), ("old", 5)], "token string, token_id int")
    logits = lambda ids: ids.withColumn("logits", F.array(F.lit(0.0), F.size("input_ids").cast("double")))
    out = scoring.score_reply(docs, vocab, logits, lex, lex.select("token"), key="doc_id")
    assert asked == ["_row"] and out.count() == docs.count()


def test_tree_measures_of_written_trees_are_those_of_the_sentences(spark, docs):
    sents = A.annotate_sentences(docs)
    trees = A.written_trees(sents)
    assert "FileScan" in plan(A.tree_stats(trees)) and "regexp_extract_all" not in plan(A.tree_stats(trees))
    for measure in (A.tree_stats, A.rule_stats, A.phrase_lengths, lambda s: A.label_counts(s, "The")):
        assert sorted(map(str, measure(trees).collect())) == sorted(map(str, measure(sents).collect()))


def test_annotations_are_read_once_for_all_measures(spark):
    from inkgauge.operators import annotate as A
    from inkgauge.plans.feature_table import annotated_features

    docs = spark.createDataFrame([(1, "The old Dog barks. It runs"), (2, "x"), (2, "Two Cats and two Dogs."), (None, "Null key here.")], "doc_id int, text string")
    sents, read = A.annotate_sentences(docs), spark.sparkContext.accumulator(0)

    def seen(tokens):
        read.add(1)
        return tokens

    marked = sents.withColumn("token", F.udf(seen, "array<string>").asNondeterministic()("token"))
    rows = {r.doc_id: r for r in annotated_features(marked).collect()}
    assert read.value == sents.count() and len(rows) == 3
    assert (rows[1].num_sentences, rows[1].num_tokens, rows[1].num_entities, rows[1].max_depth) == (2, 7, 1, 2)
