import math
import random

import pytest
from pyspark.sql import functions as F

from inkgauge.functions import text
from inkgauge.functions import vectors as VX
from inkgauge.operators import additive as AD
from inkgauge.operators import flow
from inkgauge.operators import models as MD
from inkgauge.operators import scaling, scorer, tokens
from inkgauge.operators.frame import interpret_score
from inkgauge.plans.feature_table import feature_table


def test_double_softmax_is_confined(one):
    assert one(VX.positive_score(F.lit([50.0, -50.0]))) == pytest.approx(1 / (1 + math.e))
    assert one(VX.positive_score(F.lit([-50.0, 50.0]))) == pytest.approx(math.e / (1 + math.e))
    assert one(VX.argmax(F.lit([1.0, 3.0, 3.0]))) == 1


def test_zero_vector_cosine_is_nan(one):
    assert math.isnan(one(VX.cosine(F.lit([0.0, 0.0]), F.lit([1.0, 0.0]))))


def test_verdicts(one):
    assert [one(interpret_score(F.lit(s))) for s in (0.1, 0.5, 0.9)] == ["human", None, "LLM"]


def test_flow_of_one_sentence_is_zero(spark):
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0]), (2, 3, [0.0, 2.0]), (3, 1, [0.0, 0.0]), (3, 2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "doc_id int, sent_id int, embedding array<double>")
    got = {r["doc_id"]: r["semantic_flow_variability"] for r in flow.semantic_flow_variability(df).collect()}
    assert got[1] == 0.0 and got[2] == pytest.approx(0.5) and math.isnan(got[3])


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0)], "id int, c double, v double")
    s = scaling.fit_scaler(df, ["c", "v"])
    mm = {r["id"]: (r["c_scaled"], r["v_scaled"]) for r in scaling.minmax_transform(df, s, ["c", "v"]).collect()}
    assert mm == {1: (0.0, 0.0), 2: (0.0, 1.0)}
    st = {r["id"]: (r["c_scaled"], r["v_scaled"]) for r in scaling.standard_transform(df, s, ["c", "v"]).collect()}
    assert st == {1: (0.0, -1.0), 2: (0.0, 1.0)}


def test_scaler_groups_reuse_given_scalers(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 10.0, 3.0)], "id int, a double, b double")
    _, fitted = scaling.scale_feature_groups(df, {"x": ["a"], "y": ["b"]})
    new = spark.createDataFrame([(3, 5.0, 5.0)], "id int, a double, b double")
    out, _ = scaling.scale_feature_groups(new, {"x": ["a"], "y": ["b"]}, fitted)
    assert tuple(out.first()) == (3, 0.5, 2.0)


def test_nearest_neighbours_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {}
    for r in MD.nearest_neighbours(df, df, 4, train_blocks=3, query_blocks=2).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour"]))
    for i, v, _y in rows:
        want = sorted(rows, key=lambda r: (math.dist(r[1], v), r[0]))[:4]
        assert [n for _rank, n in sorted(got[i])] == [w[0] for w in want]


def test_the_kth_distance_is_not_sought_among_all_rows(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    inf = float("inf")
    far = [i for i in range(2500) if i % 97 == 0]
    rng = np.random.default_rng(3)
    rows = [(i, [1000.0 + x for x in rng.integers(-9, 10, 3).tolist()]) for i in range(2500)]
    rows += [(5000 + i, [float("nan"), 1.0, 2.0]) for i in range(30)] + [(6000, [inf, 0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<double>, label int")
    got = {}
    for r in MD.nearest_neighbours(df, df, 7, train_blocks=1, query_blocks=1).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour"]))
    for i in far:
        want = sorted((math.dist(rows[i][1], v), t) for t, v in rows[:2500])[:7]
        assert [n for _, n in sorted(got[i])] == [t for _, t in want]
    assert set(got) == set(range(2500))

    seen = []
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda a, *r, **o: seen.append(a.shape[1]) or partition(a, *r, **o))
    left = pd.DataFrame({"q": range(5), "v": [np.array(v) for _, v in rows[:5]], "qb": 0, "tb": 0})
    right = pd.DataFrame({"t": range(2500), "v": [np.array(v) for _, v in rows[:2500]], "y": 0.0, "tb": 0, "qb": 0})
    found = MD.block_search(7)(left, right)
    assert len(found) == 35 and seen and max(seen) <= 2500 // MD.GROUP


def test_additive_model_separates_and_explains(spark):
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random()) for i in range(1500)]
    data = [(i, a, b, int(a > 0.6 or rng.random() < 0.05)) for i, a, b in rows]
    df = spark.createDataFrame(data, "id int, a double, b double, label int")
    model = AD.fit_additive_boosting(df, ["a", "b"], bins=8, rounds=12, lr=0.5)
    scored = AD.predict_additive(df, model)
    hit = scored.agg(F.avg(((F.col("score") > 0.5).cast("int") == F.col("label")).cast("double"))).first()[0]
    assert hit > 0.85
    imp = {r["term"]: r["importance"] for r in AD.term_importance(AD.explain_additive(df, model, "id")).collect()}
    assert imp["a"] > 5 * imp["b"]
    total = AD.explain_additive(df, model, "id").groupBy("id").agg(F.sum("contribution").alias("c"))
    gap = total.join(scored, "id").agg(F.max(F.abs(F.col("raw") - F.col("c") - F.lit(model.intercept)))).first()[0]
    assert gap < 1e-9


def test_one_newton_step_by_hand(spark):
    # left bin: 1 of 4 positive, right bin: 3 of 4; overall one half
    data = [(float(i >= 4), int(i in (3, 5, 6, 7))) for i in range(8)]
    df = spark.createDataFrame(data, "x double, label int")
    model = AD.fit_additive_boosting(df, ["x"], bins=4, rounds=1, lr=1.0)
    assert model.intercept == 0.0 and model.scores["x"] == pytest.approx([-1.0, 1.0, 0.0])
    with pytest.raises(ValueError):
        AD.fit_additive_boosting(df.where("label = 1"), ["x"])


def test_missing_values_have_a_bin_of_their_own(spark):
    data = [(0.0, 0), (1.0, 0), (2.0, 1), (3.0, 1), (None, 1), (None, 1), (float("nan"), 1), (None, 0)]
    df = spark.createDataFrame(data, "x double, label int")
    model = AD.fit_additive_boosting(df, ["x"], bins=2, rounds=1, lr=1.0)
    assert len(model.bounds["x"]) == 1 and len(model.scores["x"]) == 3
    score = {str(r["x"]): r["score"] for r in AD.predict_additive(df, model).collect()}
    assert score["None"] == score["nan"] and score["0.0"] < score["nan"] < score["3.0"]


def test_scaler_ignores_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "x double")
    scaler = scaling.fit_scaler(df, ["x"])
    assert tuple(scaler.first())[1:] == (1.0, 3.0, 2.0, 1.0)
    got = [r[0] for r in scaling.minmax_transform(df, scaler, ["x"]).collect()]
    assert got[:2] == [0.0, 1.0] and got[2] != got[2] and got[3] is None
    got = [r[0] for r in scaling.standard_transform(df, scaler, ["x"]).collect()]
    assert got[:2] == [-1.0, 1.0]
    none = df.where("x is null or isnan(x)")
    assert scaling.minmax_transform(none, scaling.fit_scaler(none, ["x"]), ["x"]).count() == 2


def test_scorer_contract_and_registry(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [-3.0, 0.0])], "id int, v array<double>")
    out = scorer.batch_score(df, scorer.engine("linear", "v", [1.0, 1.0]), "id int, v array<double>, score double, prediction int")
    assert {r["id"]: (r["score"], r["prediction"]) for r in out.collect()} == {1: (3.0, 1), 2: (-3.0, 0)}
    with pytest.raises(ValueError):
        scorer.engine("nothing")


def test_grid_sample_is_seeded_and_distinct():
    grid = {"a": list(range(10)), "b": list(range(10))}
    one, two = MD.sample_grid(grid, 20, 3), MD.sample_grid(grid, 20, 3)
    assert one == two and len({tuple(sorted(p.items())) for p in one}) == 20
    assert len(MD.sample_grid({"a": [1, 2]}, 9, 0)) == 2


def test_encoding_pads_truncates_and_marks(spark):
    docs = spark.createDataFrame([(1, "a b a zz"), (2, " ".join(["a"] * 50)), (3, "")], "doc_id int, text string")
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "token string, token_id int")
    got = {r["doc_id"]: (r["input_ids"], r["attention_mask"]) for r in tokens.encode_tokens(docs, vocab, 8).collect()}
    assert got[1] == ([2, 4, 5, 4, 1, 3, 0, 0], [1] * 6 + [0, 0])
    assert got[2] == ([2] + [4] * 6 + [3], [1] * 8)
    assert got[3] == ([2, 3] + [0] * 6, [1, 1] + [0] * 6)


def test_encoding_by_join_and_truncation_flag(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b a zz"), (2, " ".join(["a"] * 50)), (3, ""), (4, "a b a zz b a")], "doc_id int, text string")
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "token string, token_id int")
    one = tokens.encode_tokens(docs, vocab, 8).collect()
    monkeypatch.setattr(tokens, "small_rows", lambda table: None)
    assert sorted(one) == sorted(tokens.encode_tokens(docs, vocab, 8).collect())
    assert {r["doc_id"]: r["truncated"] for r in one} == {1: False, 2: True, 3: False, 4: False}


def test_joins_keep_repeated_and_null_keys_apart(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(1, "help the money"), (1, "money money"), (None, "help"), (None, "help"), (2, None), (2, "a b c d e f g"), (3, "")], "doc_id int, text string"
    )
    lex = spark.createDataFrame([("h", "help"), ("m", "money"), ("m", ""), ("h", None)], "category string, token string")
    vocab = spark.createDataFrame([("help", 4), ("money", 5), ("money", 9), ("the", 6), (None, 7)], "token string, token_id int")

    def rows(df):
        return sorted(map(repr, df.collect()))

    hits, ids = rows(tokens.lexicon_scores(docs, lex, ["h", "m"])), rows(tokens.encode_tokens(docs, vocab, 6))
    assert len(hits) == len(ids) == 7 and any("input_ids=[2, 5, 5, 3, 0, 0]" in r for r in ids)
    monkeypatch.setattr(tokens, "small_rows", lambda table: None)
    assert rows(tokens.lexicon_scores(docs, lex, ["h", "m"])) == hits
    assert rows(tokens.encode_tokens(docs, vocab, 6)) == ids


@pytest.mark.parametrize("name", ["t11_lexicon_scores", "v1_encode_tokens", "t22_feature_table", "plan_score_reply"])
def test_queries_hold_their_sql_where_lookups_are_joined(spark, monkeypatch, name):
    from inkgauge.plans import feature_table as FT
    from suite.all import ORACLES, QUERIES
    from suite.check import compare, connect

    monkeypatch.setattr(tokens, "small_rows", lambda table: None)
    monkeypatch.setattr(FT, "small_rows", lambda table: None)
    sf = "/root/testdata/sf0.001"
    state, detail = compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name])
    assert state != "FAIL", detail


def test_small_rows_are_bounded_in_rows_and_bytes(spark):
    from inkgauge.session import lookup_table, small_rows, written

    table = written(spark.range(100).selectExpr("id", "repeat('x', 100) AS t"), "t")
    assert len(small_rows(table)) == 100
    assert small_rows(table, max_rows=99) is None and small_rows(table, max_bytes=5000) is None
    assert lookup_table(spark.range(7)).count() == 7 and small_rows(table.limit(0)) == []


def test_lexicon_in_the_row_and_by_join_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "This is a class . Assist this class , no ."), (2, ""), (3, None), (4, "zzz")], "doc_id int, text string")
    lex = spark.createDataFrame([("a", "this"), ("b", "this"), ("a", "class"), ("b", "assist"), ("c", "none"), ("x", "is")], "category string, token string")
    rows = [tokens.lexicon_scores(docs, lex, ["a", "b", "c"]).collect()]
    monkeypatch.setattr(tokens, "small_rows", lambda table: None)
    rows.append(tokens.lexicon_scores(docs, lex, ["a", "b", "c"]).collect())
    assert sorted(rows[0]) == sorted(rows[1])
    assert {r["doc_id"]: (r["a"], r["b"], r["c"]) for r in rows[0]}[1] == (4 / 11, 3 / 11, 0.0)


def test_lexicon_and_familiar_words_meet_the_text_in_its_form(spark):
    docs = spark.createDataFrame([(1, "This is a class. Assist this class.")], "doc_id int, text string")
    lex = spark.createDataFrame([("a", "this"), ("b", "class"), ("c", "assist")], "category string, token string")
    known = spark.createDataFrame([("this",), ("is",), ("a",), ("class",), ("assist",)], "token string")
    row = feature_table(docs, lex, known, ["a", "b", "c"]).first()
    assert (row["a"], row["b"], row["c"]) == (2 / 9, 2 / 9, 1 / 9) and row["dale_chall"] < 1


def test_entropy_of_characters(spark):
    texts = ["", "aaaa", "ab", "a\U0001F600", "abcd", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r["e"] for r in df.select("id", text.textual_entropy("t").alias("e")).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 1.0, 3: 1.0, 4: 2.0, 5: None}


def test_lemma_table_in_cleaning_and_lookups(spark, monkeypatch):
    from inkgauge.plans import feature_table as FT

    docs = spark.createDataFrame([(1, "Mice ran. The glass was thin, cats!"), (2, ""), (3, None)], "doc_id int, text string")
    lemmas = spark.createDataFrame([("mice", "mouse"), ("ran", "run"), ("glass", "glass"), ("was", "be"), (None, "x")], "token string, lemma string")
    one = {r["doc_id"]: r["clean"] for r in FT.cleaned(docs, lemmas=lemmas).collect()}
    assert one[1] == "mouse run . The glass be thin , cat !" and not one[2] and not one[3]
    lex = spark.createDataFrame([("a", "mice"), ("a", "cats"), ("b", "glass")], "category string, token string")
    row = FT.feature_table(docs, lex, lex.select("token"), ["a", "b"], lemmas=lemmas).where("doc_id = 1").first()
    assert (row["a"], row["b"]) == (2 / 10, 1 / 10)
    monkeypatch.setattr(FT, "small_rows", lambda table: None)
    assert FT.cleaned(docs, lemmas=lemmas).where("doc_id = 1").first()["clean"] == one[1]


def test_lemma_join_gives_the_features_of_the_look_up(spark, monkeypatch):
    from inkgauge.plans import feature_table as FT

    docs = spark.createDataFrame([(1, "Mice ran. The glass was thin, cats!"), (2, "Dogs ran."), (2, "The mice."), (None, "Cats was mice."), (3, None), (4, "")], "doc_id int, text string")
    lemmas = spark.createDataFrame([("mice", "mouse"), ("ran", "run"), ("was", "be")], "token string, lemma string")
    lex = spark.createDataFrame([("a", "mice"), ("a", "cats"), ("a", "mice"), ("b", "glass"), ("b", "ran"), ("b", None)], "category string, token string")
    familiar = spark.createDataFrame([("the",), ("mice",), ("cats",), ("was",)], "token string")

    def rows(df):
        return sorted(map(repr, df.collect()))

    clean, table = rows(FT.cleaned(docs, lemmas=lemmas)), rows(FT.feature_table(docs, lex, familiar, ["a", "b"], lemmas=lemmas))
    monkeypatch.setattr(FT, "small_rows", lambda table: None)
    assert rows(FT.cleaned(docs, lemmas=lemmas)) == clean
    assert rows(FT.feature_table(docs, lex, familiar, ["a", "b"], lemmas=lemmas)) == table


def test_sentence_vectors_and_missing_annotations(spark):
    from inkgauge.operators import annotate as A
    from inkgauge.plans.feature_table import feature_table as table

    docs = spark.createDataFrame([(1, "One two three. Four five."), (2, "Six seven.")], "doc_id int, text string")
    lex = spark.createDataFrame([("a", "one")], "category string, token string")
    vectors = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (1, 3, [0.0, 2.0])], "doc_id int, sent_id int, embedding array<double>")
    sents = A.annotate_sentences(docs.where("doc_id = 1"))
    rows = {r["doc_id"]: r for r in table(docs, lex, lex.select("token"), ["a"], annotations=sents, vectors=vectors).collect()}
    assert rows[1]["semantic_flow_variability"] == pytest.approx(0.5) and rows[2]["semantic_flow_variability"] == 0.0
    assert rows[1]["num_sentences"] == 2 and rows[2]["num_sentences"] == 0 and rows[2]["most_common_rule"] is None
    assert math.isnan(rows[2]["depth_variability"])


def test_neighbours_by_text_keys(spark):
    rng = random.Random(8)
    rows = [(f"k{i:02d}", [float(rng.randint(0, 3)) for _ in range(3)], i) for i in range(40)]
    df = spark.createDataFrame(rows, "name string, embedding array<double>, label int")
    got = MD.nearest_neighbours(df, df, 4, "name", train_blocks=3, query_blocks=2).collect()
    want = []
    for q, v, _ in rows:
        near = sorted((math.dist(v, w), t) for t, w, _ in rows)[:4]
        want += [(q, t, r) for r, (_, t) in enumerate(near, 1)]
    assert sorted((r["name"], r["neighbour"], r["rank"]) for r in got) == sorted(want)


def test_infinite_values_do_not_count_in_scalers(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (inf, -inf), (-inf, 2.0), (None, float("nan"))], "a double, b double")
    fitted = scaling.fit_scaler(df, ["a", "b"])
    assert {r["col"]: (r["min"], r["max"], r["mean"]) for r in fitted.collect()} == {"a": (1.0, 3.0, 2.0), "b": (2.0, 2.0, 2.0)}
    got = [tuple(r) for r in scaling.minmax_transform(df, fitted, ["a", "b"]).collect()]
    assert got[:4] == [(0.0, 0.0), (1.0, 0.0), (inf, -inf), (-inf, 0.0)] and got[4][0] is None and math.isnan(got[4][1])
    assert [r["b_scaled"] for r in scaling.standard_transform(df, fitted, ["b"]).collect()][:4] == [0.0, 0.0, -inf, 0.0]


def test_every_request_has_a_reply(spark):
    from inkgauge.plans import scoring

    rows = [(1, "Help the money."), (1, "Money money. Run!"), (None, "Help."), (None, "Help."), (2, None), (3, "")]
    asked = spark.createDataFrame(rows, "request_id int, text string")
    lex = spark.createDataFrame([("a", "help"), ("a", "money")], "category string, token string")
    known = spark.createDataFrame([("the",), ("help",)], "token string")
    vocab = spark.createDataFrame([("help", 4), ("money", 5)], "token string, token_id int")

    def logits(ids):
        return ids.withColumn("logits", F.array(F.lit(1.0), F.size("input_ids").cast("double")))

    replies = scoring.score_reply(asked, vocab, logits, lex, known).collect()
    assert sorted(str(r.request_id) for r in replies) == sorted(str(i) for i, _ in rows)
    scored = scoring.score_features(asked, lex, known, lambda t: t.withColumn("score", F.lit(0.5))).collect()
    assert sorted(str(r.request_id) for r in scored) == sorted(str(i) for i, _ in rows)
    tokens_of = sorted(r.features["num_tokens"] for r in scored if r.request_id == 1)
    assert tokens_of == [4.0, 5.0]
    # the tables of the feature table count here too
    lemmas = spark.createDataFrame([("money", "help")], "token string, lemma string")
    tags = spark.createDataFrame([("help", "NN")], "token string, tag string")
    with_tables = scoring.score_features(asked, lex, known, lambda t: t.withColumn("score", F.lit(0.5)), lemmas=lemmas, tags=tags)
    own = feature_table(asked.where("text like 'Money%'").withColumn("doc_id", F.lit(9)), lex, known, lemmas=lemmas, tags=tags).first()
    one = next(r for r in with_tables.collect() if r.features["num_tokens"] == 5.0)
    assert one.features["semantic_density"] == own["semantic_density"] and one.features["num_unique_lemmas"] == own["num_unique_lemmas"]
