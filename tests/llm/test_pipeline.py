"""Stages on a table with odd rows, each against brute force on its own input, and run() as a whole."""

import random
import zlib
from functools import partial

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as c

from .helpers import odd_documents, sentence, words
from .test_order_minhash import classes_of, edited, large_groups, linked_classes
from .test_repeats import brute


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(21)
    rows = [(i, sentence(rng, rng.randint(12, 120), "abcdefgh" if i % 2 else "stuvwxyz")) for i in range(80)]
    common = sentence(rng, 70)
    rows += [(100 + i, sentence(rng, 90) + " " + common) for i in range(5)] + [(200 + i, edited(rng, rows[i][1], 1)) for i in range(12)]
    rows += [(300 + i, rows[i][1]) for i in range(6)] + [(400, None), (401, ""), (402, "12 .. 34"), (20, rows[20][1]), (None, rows[3][1]), (403, common)]
    return odd_documents(spark, rows).withColumn("lang", F.when(F.col("doc_id") < 80, F.when(F.col("doc_id") % 2 == 1, "left").otherwise("right")))


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_language_stage(spark, docs):
    got = c.language(spark, docs, "")
    assert got.columns == docs.columns
    assert rows_of(got) == rows_of(docs.where("doc_id is null or doc_id not in (400, 401, 402)"))
    assert c.language(spark, docs.limit(0), "").count() == 0


def test_near_duplicate_stage(spark, docs):
    got = c.near_duplicates(spark, docs, "")
    of = classes_of([(r.doc_id, r.text) for r in docs.collect()])
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in of if of[i] == i) and ids.count(None) == 1
    assert c.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_near_duplicate_stage_keeps_one_of_many_edits_around_a_middle_base(spark):
    rows = large_groups(120, 7)
    got = c.near_duplicates(spark, odd_documents(spark, rows), "")
    of = linked_classes(rows)
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i in of if of[i] == i)


def test_passage_stage(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    left = sorted([(i, t.split(" ") if t else []) for i, n, m, t in brute(rows, 50) if m < n or not m], key=str)
    got = c.repeated_passages(spark, docs, "")
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert sorted([(r.doc_id, words(r.text)) for r in got.collect()], key=str) == left
    assert all(r.n_chars == len(r.text or "") for r in got.collect())


def test_mixing_stage(spark, docs):
    got = c.mixing(spark, docs, "")
    before, after = rows_of(docs), rows_of(got)
    assert set(after) == set(before) and got.columns == docs.columns
    assert all(before.count(r) <= after.count(r) <= 2 * before.count(r) for r in set(before))
    assert c.mixing(spark, docs.limit(0), "").count() == 0


def test_mixing_stage_writes_the_blocks_of_the_mix(spark, docs, monkeypatch):
    from inkgauge.llm import op3_mixing

    rows = docs.withColumn("source", F.when(F.col("doc_id") % 5 == 0, "few").otherwise(F.col("source"))).unionAll(docs.where("doc_id is null"))
    monkeypatch.setattr(op3_mixing, "mix_sources", partial(op3_mixing.mix_sources, block_tokens=600))
    sums = {}
    for r in op3_mixing.mix_sources(rows).collect():
        sums[r.source] = sums.get(r.source, 0) + r.n_tokens
    got = c.mixing(spark, rows, "").collect()
    tokens = [(r.source, len(words(r.text))) for r in got]
    most = max(n for _, n in tokens)
    assert {s for s, _ in tokens} == set(sums) and all(abs(sum(n for x, n in tokens if x == s) - total) <= most for s, total in sums.items())
    # every stretch of the output has its sources in their shares, not one after another
    half = len(tokens) // 2
    for s, total in sums.items():
        first = sum(n for x, n in tokens[:half] if x == s)
        assert abs(2 * first - total) <= 0.4 * total + 2 * most


def test_packing_stage(spark, docs):
    from .test_packing import check

    assert c.packing(spark, docs.limit(0), "").count() == 0
    got = c.packing(spark, docs, "").collect()
    check(got, 2048)
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in docs.collect():
        ids = own.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.append((r.doc_id, 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)


def test_run_on_an_empty_table(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert c.run(spark, str(tmp_path)).count() == 0


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = c.run(spark, str(tmp_path)).collect()
    step = docs
    for _, stage in c.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, "").collect(), docs.schema)
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in step.collect():
        ids = np.array(own.encode(r.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        assert len(ids) <= 2048
        want.append((r.doc_id, 0, 0, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    assert [n for n, _ in c.STAGES] == ["language", "near_duplicates", "repeated_passages", "mixing", "packing"]
