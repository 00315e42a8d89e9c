import random

import numpy as np
import pyarrow as pa
import pytest

from inkgauge.llm import op8_order_minhash as o
from inkgauge.llm.components import components
from inkgauge.llm.words import Words

from .helpers import odd_documents, sentence, words


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_similarity(a, b, n=5):
    a, b = words(a), words(b)
    a = [tuple(a[i : i + n]) for i in range(len(a) - n + 1)]
    b = [tuple(b[i : i + n]) for i in range(len(b) - n + 1)]
    if not a or not b:
        return 0.0
    m = common_subsequence(a, b)
    return m / (len(a) + len(b) - m)


def classes_of(rows, threshold=0.8):
    """Classes by comparing everything with everything."""
    of = {i: i for i, _ in rows if i is not None}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    known = [(i, t) for i, t in rows if i is not None and words(t)]
    for k, (i, t) in enumerate(known):
        for j, s in known[:k]:
            if words(t) == words(s) or plain_similarity(t, s) >= threshold:
                a, b = find(i), find(j)
                of[max(a, b)] = min(a, b)
    return {i: find(i) for i in of}


def edited(rng, text, edits):
    ws = words(text)
    for _ in range(edits):
        ws[rng.randrange(len(ws))] = sentence(rng, 1)
    return " ".join(ws)


def cases():
    rng = random.Random(9)
    rows, i = [], 0
    for _ in range(12):
        text = sentence(rng, rng.randint(30, 160))
        for k in range(rng.randint(1, 5)):
            rows.append((i, edited(rng, text, k) if k else text))
            i += 1
    text = sentence(rng, 120)
    rows += [(200 + k, edited(rng, text, rng.randint(0, 3))) for k in range(30)]
    rows += [(300, text), (301, "  " + text.replace(" ", "\n")), (302, "a b c"), (303, "a b c"), (304, "a b d")]
    rows += [(400, None), (401, ""), (402, " "), (403, ""), (500, rows[0][1]), (500, rows[0][1]), (501, rows[1][1]), (501, "q w e r t y")]
    rows += [(600, " ".join(["la"] * 40)), (601, " ".join(["la"] * 41)), (602, " ".join(["la"] * 80))]
    return rows


def test_classes_are_those_of_brute_force(spark):
    rows = cases()
    docs = odd_documents(spark, rows)
    got = o.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.id: r.class_id for r in got} == classes_of(rows)


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(o, "SMALL", 2)
    rows = cases()
    got = o.near_duplicates(odd_documents(spark, rows)).collect()
    assert {r.id: r.class_id for r in got} == classes_of(rows)


def test_null_ids_and_empty_table(spark):
    docs = odd_documents(spark, [(None, "a b c d e f g"), (None, "a b c d e f g"), (1, "a b c d e f g")])
    assert sorted([(r.id, r.class_id) for r in o.near_duplicates(docs).collect()], key=str) == [(1, 1), (None, None), (None, None)]
    assert o.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_alignment_equals_the_plain_one(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 12, rng.integers(1, 60))
    b = a.copy() if seed % 2 else rng.integers(0, 12, rng.integers(1, 60))
    b = np.delete(b, rng.integers(0, len(b), 2)) if len(b) > 3 else b
    m = common_subsequence(a.tolist(), b.tolist())
    assert o.kept_in_band(a, b, max(len(a), len(b))) == m
    full = m / (len(a) + len(b) - m)
    got = o.similarity(a, b, 0.8)
    assert (got >= 0.8) == (full >= 0.8)
    if full >= 0.8:
        assert got == pytest.approx(full)


def test_sketch_depends_on_words_alone():
    one = Words(pa.array(["z z z z z z", "a b c d e f g h", "x"]))
    two = Words(pa.array(["a  b\nc d e f g h"]))
    rows, found = o.sketches(one, 5, 8, 3)
    assert rows.tolist() == [0, 1]
    assert (o.sketches(two, 5, 8, 3)[1][0] == found[1]).all()


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), (30, 31), (31, 32), (32, 33), (33, 1)], "a long, b long")
    assert {r.node: r.class_id for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 30: 1, 31: 1, 32: 1, 33: 1}
    assert components(links.limit(0)).count() == 0


def large_groups(edits, seed):
    """Edited copies around a base of middle id, linked through it alone, and texts of a template with near pairs among them."""
    rng = random.Random(seed)
    base = sentence(rng, 204)
    rows = [(k if k < edits // 2 else k + 1, edited(rng, base, 4)) for k in range(edits)] + [(edits // 2, base)]
    template = sentence(rng, 130)
    for k in range(60):
        text = f"{template} {sentence(rng, 70)}"
        rows += [(1000 + k, text), (2000 + (k * 37) % 60, edited(rng, text, 2))] if k % 3 == 0 else [(1000 + k, text)]
    return rows


def near_pairs(rows, linked=lambda i, j: False, threshold=0.8):
    """Pairs at the threshold that are not linked yet; only those whose shingles allow it are aligned, the most similar first."""
    texts, grams, may = dict(rows), {}, []
    for i, t in rows:
        w = words(t)
        grams[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for k, (i, _) in enumerate(rows):
        for j, _ in rows[:k]:
            common = len(grams[i] & grams[j])
            share = common / (len(grams[i]) + len(grams[j]) - common)
            if share >= threshold:
                may.append((-share, min(i, j), max(i, j)))
    for _, i, j in sorted(may):
        if not linked(i, j) and plain_similarity(texts[i], texts[j]) >= threshold:
            yield i, j


def linked_classes(rows):
    of = {i: i for i, _ in rows}
    for i, j in near_pairs(rows, lambda i, j: of[i] == of[j]):
        low, high = sorted((of[i], of[j]))
        of = {k: low if c == high else c for k, c in of.items()}
    return of


def test_edits_around_a_middle_base_and_template_texts_are_those_of_brute_force(spark):
    few, many = large_groups(100, 1), [(10_000 + i, t) for i, t in large_groups(500, 2)]
    got = {r.id: r.class_id for r in o.near_duplicates(odd_documents(spark, few + many)).collect()}
    assert got == linked_classes(few) | linked_classes(many)


@pytest.mark.parametrize("part", [7, 512])
def test_exact_pairs_hold_every_near_pair(spark, monkeypatch, part):
    monkeypatch.setattr(o, "PART", part)
    rows = large_groups(40, 3)
    table = spark.createDataFrame([(i, i, t) for i, t in rows], "id long, class_id long, text string")
    got = {(r.a, r.b) for r in o.exact_pairs(table, 5, 0.8).collect()}
    near = set(near_pairs(rows))
    assert near and near <= got


def test_copies_that_differ_do_not_meet_in_what_all_share(spark):
    rng = random.Random(8)
    base = sentence(rng, 250)
    rows = [(k, edited(rng, base, 4 + k % 6)) for k in range(2000)]
    close = [(5000 + k, edited(rng, rows[k][1], 1)) for k in range(0, 2000, 50)]
    table = spark.createDataFrame([(i, i, t) for i, t in rows + close], "id long, class_id long, text string")
    prefixes = o.written(o.rarest(table, 5, 0.8), "prefixes")
    got = [(r.a, r.b) for r in o.meetings(prefixes, 0.8).collect()]
    hot = prefixes.groupBy("key").count().agg({"count": "max"}).first()[0]
    assert hot > 1500  # a shingle of the base that most copies hold
    assert {(i - 5000, i) for i, _ in close} <= set(got)
    assert len(got) < 20 * len(rows)  # of two million pairs


def test_very_long_texts_are_compared_whole(spark):
    rng = random.Random(12)
    long = sentence(rng, 12_000)
    rows = [(1, long), (2, edited(rng, long, 20)), (3, long + " " + sentence(rng, 9000)), (4, " ".join(words(long)[:6000]))]
    got = {r.id: (r.class_id, r.n_words) for r in o.near_duplicates(odd_documents(spark, rows)).collect()}
    assert got == {1: (1, 12_000), 2: (1, 12_000), 3: (3, 21_000), 4: (4, 6000)}


def test_the_first_text_of_each_row_is_looked_up_once(spark):
    rng = random.Random(4)
    base = sentence(rng, 40)
    rows = [(7, base), (3, base), (3, sentence(rng, 30)), (5, sentence(rng, 20)), (9, base), (None, base), (8, None), (3, base)]
    out = o.near_duplicates(odd_documents(spark, rows))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # not a third: the table of copies is there, not made again
    assert {(r.id, r.class_id) for r in out.collect()} == {(7, 3), (3, 3), (5, 5), (9, 3), (None, None), (8, 8)}
