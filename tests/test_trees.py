import random
import statistics

import pytest
from pyspark.sql import functions as F

from inkgauge.functions.trees import depths, left_spine, preorder_key, tree_shape
from inkgauge.operators import annotate as A


def random_heads(n, rng):
    order = list(range(1, n + 1))
    rng.shuffle(order)
    heads = [0] * n
    for i, node in enumerate(order[1:], 1):
        heads[node - 1] = rng.choice(order[:i])
    return heads


def brute(heads):
    n = len(heads)
    kids = {i: [j + 1 for j in range(n) if heads[j] == i] for i in range(n + 1)}
    depth = {}

    def walk(v, d):
        depth[v] = d
        for k in kids[v]:
            walk(k, d + 1)

    root = kids[0][0]
    walk(root, 0)
    spine, cur = 0, root
    while kids[cur]:
        cur, spine = kids[cur][0], spine + 1
    pre = []

    def preorder(v):
        pre.append(v)
        for k in kids[v]:
            preorder(k)

    preorder(root)
    return {
        "depths": [depth[i + 1] for i in range(n)],
        "branching": len(kids[root]),
        "leaves": sum(not kids[i + 1] for i in range(n)),
        "spine": spine,
        "preorder": pre,
    }


def test_shapes_against_brute_force(spark):
    rng = random.Random(5)
    trees = [random_heads(rng.randint(2, 40), rng) for _ in range(60)]
    trees.append([0] + list(range(1, 60)))
    trees.append([0] + [1] * 30)
    df = spark.createDataFrame(list(enumerate(trees)), "id int, head array<int>")
    h = F.col("head")
    out = df.select(
        "id",
        depths(h).alias("depths"),
        tree_shape(h).alias("s"),
        left_spine(h, F.array_max(depths(h))).alias("spine"),
        F.transform(F.sequence(F.lit(1), F.size(h)), lambda p: preorder_key(h, p, F.get(depths(h), p - 1))).alias("keys"),
    ).collect()
    for r in out:
        want = brute(trees[r["id"]])
        assert r["depths"] == want["depths"]
        assert r["s"]["depth"] == max(want["depths"])
        assert r["s"]["branching"] == want["branching"]
        assert r["s"]["leaves"] == want["leaves"]
        assert r["s"]["spine"] == want["spine"] == r["spine"]
        assert sorted(range(1, len(r["keys"]) + 1), key=lambda p: r["keys"][p - 1]) == want["preorder"]


def sentences(spark, rows):
    cols = "doc_id int, sent_id int, token array<string>, head array<int>"
    return spark.createDataFrame(rows, cols)


def test_single_token_sentences_have_no_tree(spark):
    df = sentences(spark, [(1, 1, ["Hi"], [0]), (2, 1, ["a", "b"], [0, 1]), (2, 2, ["c"], [0])])
    got = {r["doc_id"]: r for r in A.tree_stats(df).collect()}
    assert got[1]["max_depth"] == 0 and got[1]["avg_branching_factor"] == 0 and got[1]["depth_variability"] != got[1]["depth_variability"]
    assert got[2]["max_depth"] == 1 and got[2]["total_nodes"] == 2 and got[2]["depth_variability"] == 0.0


def brute_shape(heads):
    kids = {}
    for i, h in enumerate(heads, 1):
        kids.setdefault(h, []).append(i)
    depth, todo = {}, [(kids[0][0], 0)]
    while todo:
        p, d = todo.pop()
        depth[p] = d
        todo += [(c, d + 1) for c in kids.get(p, [])]
    spine, p = 0, kids[0][0]
    while p in kids:
        spine, p = spine + 1, kids[p][0]
    return max(depth.values()), len(kids.get(kids[0][0], [])), len(heads), sum(i not in kids for i in range(1, len(heads) + 1)), spine


def test_long_sentences_have_trees_like_any_other(spark):
    rng = random.Random(6)
    n = 5000
    shapes = {
        1: [0] + [1] * (n - 1), 2: [i // 2 for i in range(1, n + 1)], 3: list(range(n)), 4: [0] + [rng.randint(1, i) for i in range(1, n)],
        5: list(range(2, 2002)) + [0], 6: [0] + [max(1, i - rng.randint(0, 2)) for i in range(1, n)], 7: [0, 1], 8: [2, 0],
    }
    df = sentences(spark, [(k, 1, ["w"] * len(h), h) for k, h in shapes.items()])
    trees = df.select("doc_id", tree_shape(F.col("head")).alias("s")).collect()
    got = {r["doc_id"]: tuple(r["s"][c] for c in ("depth", "branching", "nodes", "leaves", "spine")) for r in trees}
    assert got == {k: brute_shape(h) for k, h in shapes.items()}
    assert {r["doc_id"]: r["total_nodes"] for r in A.tree_stats(df).collect()} == {k: len(h) for k, h in shapes.items()}


def test_spread_of_depths(spark):
    chain = list(range(8))
    df = sentences(spark, [(1, i + 1, ["w"] * n, chain[:n]) for i, n in enumerate([2, 4, 8])])
    row = A.tree_stats(df).first()
    assert row["depth_variability"] == pytest.approx(statistics.pstdev([1, 3, 7]))
    assert row["tree_height_variability"] == pytest.approx(statistics.pstdev([1, 3, 7]))


def test_rule_ties_follow_the_preorder_walk(spark):
    # root c (3), children a (1) and d (4); a has b, d has e: pre-order c a b d e
    df = sentences(spark, [(1, 1, ["a", "b", "c", "d", "e"], [3, 1, 0, 3, 4])])
    row = A.rule_stats(df).first()
    assert (row["unique_rules"], row["most_common_rule"]) == (3, "c")


def test_array_and_table_forms_agree(spark):
    text = "The Old house stood Near Paris. Running dogs, running cats! The nation. Ok"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "One")], "doc_id int, text string")
    rows = docs.select("doc_id", A.syntax_struct(F.col("text")).alias("s")).select("doc_id", "s.*")
    flat = {r["doc_id"]: r.asDict() for r in rows.collect()}
    tokens, sents = A.annotate(docs), A.annotate_sentences(docs)
    for df in (A.token_stats(tokens), A.entity_stats(tokens), A.noun_chunk_stats(tokens), A.rule_stats(sents)):
        for r in df.collect():
            for k, v in r.asDict().items():
                if k != "doc_id":
                    assert flat[r["doc_id"]][k] == pytest.approx(v) if isinstance(v, float) else flat[r["doc_id"]][k] == v, k
    assert flat[2]["num_tokens"] == 0 and flat[2]["most_common_rule"] is None


def test_annotations_round_trip(spark):
    docs = spark.createDataFrame([(1, "The big Cat sat. It ran away quickly!")], "doc_id int, text string")
    sents = A.annotate_sentences(docs)
    back = A.collect_annotations(A.explode_annotations(sents))
    key = lambda r: r["sent_id"]
    assert sorted(back.collect(), key=key) == sorted(sents.select(*back.columns).collect(), key=key)


def test_multi_token_spans(spark):
    rows = [
        (1, 1, 1, "New", "new", "NNP", 0, 1, 1), (1, 1, 2, "York", "york", "NNP", 1, 1, 1), (1, 1, 3, "is", "be", "VBZ", 1, None, None),
        (1, 2, 1, "New", "new", "NNP", 0, 1, 1), (1, 2, 2, "York", "york", "NNP", 1, 1, 1),
    ]
    df = spark.createDataFrame(rows, "doc_id int, sent_id int, pos int, token string, lemma string, tag string, head int, ent_id int, chunk_id int")
    e = A.entity_stats(df).first()
    assert (e["num_entities"], e["num_distinct_entities"], e["average_entity_length"]) == (2, 1, 8.0)
    c = A.noun_chunk_stats(df).first()
    assert (c["num_noun_chunks"], c["average_noun_chunk_length"]) == (2, 8.0)
