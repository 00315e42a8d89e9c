"""Repeated passages against brute force, for both ways to find them."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from inkgauge.llm import repeats
from inkgauge.llm.op2_substring import op2_substring_dedup, substring_dedup
from inkgauge.llm.op5_suffix import op5_suffix_dedup, suffix_dedup

from .helpers import odd_documents, sentence, words

SMALL = "/root/testdata/sf0.001"


def brute(rows, n):
    first = {}
    for i, t in rows:
        ws, key = words(t), repeats.NULL_ID if i is None else i
        for j in range(len(ws) - n + 1):
            k = tuple(ws[j : j + n])
            first[k] = min(first.get(k, key), key)
    out = []
    for i, t in rows:
        ws, key = words(t), repeats.NULL_ID if i is None else i
        gone = [False] * len(ws)
        for j in range(len(ws) - n + 1):
            if first[tuple(ws[j : j + n])] < key:
                gone[j : j + n] = [True] * n
        out.append((i, len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone) if not g)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(4)
    common, other = sentence(rng, 80), sentence(rng, 50)
    rows = [(100 + k, sentence(rng, rng.randint(0, 30)) + " " + common[rng.randint(0, 40) :] + "\n" + sentence(rng, 12)) for k in range(60)]
    rows += [(k, t) for k, (_, t) in enumerate(rows[:20])]
    rows += [(300, other), (301, other), (301, other), (302, "x " + other + " y"), (303, other + " " + other)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (None, other), (None, common), (403, " ".join(["a"] * 200)), (2, " ".join(["a"] * 70))]
    rows += [(500, sentence(rng, 20_000)), (501, "é" * 5000)]
    return rows


@pytest.mark.parametrize("dedup,window", [(substring_dedup, 50), (suffix_dedup, 50), (substring_dedup, 10), (lambda d, window: suffix_dedup(d, window=window, prefix=5), 10)])
def test_removed_words(spark, dedup, window, monkeypatch):
    rows = cases()
    got = dedup(odd_documents(spark, rows), window=window).collect()
    assert sorted([(r.id, r.n_words, r.n_removed, r.kept_text) for r in got], key=str) == brute(rows, window)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert r.rest.chunk == 7 and r.rest.id == 1.5


@pytest.mark.parametrize("dedup", [substring_dedup, suffix_dedup])
def test_text_as_it_stands_and_empty_table(spark, dedup):
    rows = cases()
    docs = odd_documents(spark, rows)
    got = dedup(docs, join_words=False).collect()
    whole = {i: t for i, t in rows if i is not None and i >= 100}
    assert all(r.kept_text == (whole[r.id] or "") for r in got if r.id in whole and not r.n_removed)
    assert dedup(docs.limit(0)).count() == 0
    assert dedup(docs.where("text is null")).agg(F.sum("n_words")).first()[0] == 0


@pytest.mark.parametrize("query", [op2_substring_dedup, op5_suffix_dedup])
def test_queries_over_whole_table(spark, query):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in query(spark, SMALL).collect()}
    assert got == {i: (n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(rows, 50)}
