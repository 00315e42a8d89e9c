import random

import numpy as np
import pyarrow as pa

from inkgauge.llm import op7_language as o

from .helpers import odd_documents, sentence

SMALL = "/root/testdata/sf0.01"
ODD = [(900, None), (901, ""), (902, " 12 34 !!"), (903, "A"), (904, "é" * 50_000), (None, "abc def"), (905, "漢字")]


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").collect()}
    rows = o.op7_language_id(spark, SMALL).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert 100 < len(held) < len(rows) / 2
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 30, "abcdef" if i % 2 else "uvwxyz")) for i in range(60)] + ODD
    docs = odd_documents(spark, rows)
    from pyspark.sql import functions as F

    labelled = docs.withColumn("lang", F.when(F.col("doc_id") < 60, F.when(F.col("doc_id") % 2 == 1, "left").otherwise("right")))
    model = o.fit_languages(labelled, per_language=1000)
    got = {r.doc_id: r.language for r in o.identify(docs, model).collect()}
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert all(got[i].lang_pred == ("left" if i % 2 else "right") for i in range(60))
    assert got[905].lang_pred in ("left", "right")
    assert o.identify(docs.limit(0), model).count() == 0
    none = o.fit_languages(labelled.where("lang is null"))
    assert {r.language.lang_pred for r in o.identify(docs, none).collect()} == {"und"}


def test_counts_of_grams():
    counts, some = o.gram_counts(pa.array(["ab", "b  !a", "", None, "1 2"]), 64, 2)
    assert counts.sum(axis=1).tolist() == [3, 5, 0, 0, 1] and some.tolist() == [True, True, False, False, False]
    assert (counts == o.gram_counts(pa.array(["AB", "B -- A", "", "", "-"]), 64, 2)[0]).all()


def test_lasso_sparsity_and_temperature():
    rng = np.random.default_rng(0)
    rows = [(np.array([k % 3, 3 + rng.integers(0, 40)]), np.array([0.8, 0.6]), k % 3) for k in range(300)]
    w = o.train_ftrl(rows, 64, 3)
    assert (w[:3].argmax(axis=1) == [0, 1, 2]).all() and (w[45:64] == 0).all()
    logits = np.array([[9.0, 0.0]] * 8 + [[0.0, 9.0]] * 2)
    t = o.fit_temperature(logits, np.zeros(10, dtype=int))
    assert o.softmax(logits / t)[0, 0] == np.clip(o.softmax(logits / t)[0, 0], 0.7, 0.9)
