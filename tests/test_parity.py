"""Column functions against the same steps written with Python's ``re``, on random texts."""

import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkgauge.functions import text as X
from inkgauge.functions import urls
from inkgauge.operators.models import sample_grid

PIECES = [
    "Task", "task", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "​", "　", "1", "23", "٣", "½", "Ⅷ",
    ".", "?", "!", ",", ";", ":", "-", "_", "'", "«", "—", "😀", "é", "é", "ß", "Σ", "日本", "AB_CD", "A_b", "word", "Words", "the", "$", "^", "[", "]", "\\",
]

CASES = {
    "newlines": (X.newlines_to_space, lambda t: re.sub(r"[\n\r]+", " ", t)),
    "spaces": (X.collapse_whitespace, lambda t: " ".join(t.split())),
    "task": (X.strip_task_prefix, lambda t: re.sub(r"^(?:Task(?:\s*\d+)?\.?\s*)?", "", t)),
    "punctuation": (X.strip_punctuation, lambda t: re.sub(r"[^\w\s.?!,]", "", t)),
    "upper": (X.drop_upper_tokens, lambda t: re.sub(r"[A-Z]+_[A-Z]+", "", t)),
    "words": (lambda c: F.size(X.words(c)), lambda t: len(re.findall(r"\w+", t))),
    "tokens": (lambda c: F.array_join(X.tokenize(c), "|"), lambda t: "|".join(re.findall(r"\w+|[^\s]", t))),
}


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id int, t string").repartition(4).cache()


@pytest.mark.parametrize("name", CASES)
def test_same_as_re(texts, name):
    rows, df = texts
    fn, want = CASES[name]
    got = {r["id"]: r["x"] for r in df.select("id", fn(F.col("t")).alias("x")).collect()}
    bad = [(t, got[i], want(t)) for i, t in rows if got[i] != want(t)]
    assert not bad, bad[:3]


def test_entropy_same_as_counter(texts):
    rows, df = texts
    got = {r["id"]: r["x"] for r in df.select("id", X.textual_entropy("t").alias("x")).collect()}
    for i, t in rows:
        n = len(t)
        want = -sum(c / n * math.log2(c / n) for c in Counter(t).values()) if n else 0.0
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_metric_names_same_as_re(texts):
    rows, df = texts
    got = {r["id"]: r["x"] for r in df.select("id", urls.metric_name("t", F.lit("v")).alias("x")).collect()}
    for i, t in rows:
        assert got[i] == re.sub(r"[^(a-zA-Z0-9_:)]", "_", f"{t}:v")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcd"), st.lists(st.integers(), min_size=1, max_size=5, unique=True), min_size=1), st.integers(1, 30), st.integers())
def test_grid_points_are_distinct_members(grid, n, seed):
    points = sample_grid(grid, n, seed)
    total = math.prod(len(v) for v in grid.values())
    assert len(points) == min(n, total) == len({tuple(sorted(p.items())) for p in points})
    assert all(set(p) == set(grid) and all(p[k] in grid[k] for k in p) for p in points)
