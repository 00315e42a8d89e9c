"""Scoring, model fitting and explanation (V6-V14, S8, F1-F6) and whole plans."""

from __future__ import annotations


from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from inkgauge.fixed import FEATURES as FEATURE_NAMES
from inkgauge.functions import text as X
from inkgauge.functions import vectors
from inkgauge.operators import additive as AD
from inkgauge.operators import evaluation as E
from inkgauge.operators import frame as P
from inkgauge.operators import models as MD
from inkgauge.operators import sampling, scorer
from inkgauge.operators.tokens import build_vocab
from inkgauge.plans import scoring, training
from inkgauge.plans.pipeline import features_pipeline
from inkgauge.session import fresh_path, written
from inkgauge.sources import sinks, stats

from . import textsql as S
from .base import ESSAYS_SQL, big, draw_hex_sql, draw_sql, essays, query, r6, table
from .text_queries import INTS, VOCAB, docs, familiar, feature_sql, lexicon

# Weights of the linear model by rule.
WEIGHTS = [((i * 7) % 11 - 5) / 10 for i in range(64)]
WEIGHTS_SQL = "[" + ", ".join(f"{w}::DOUBLE" for w in WEIGHTS) + "]"


def vecs(spark, sf):
    """Embeddings as MLlib vectors with a 0/1 label (label at least 4)."""
    return table(spark, sf, "embeddings").select(
        "vec_id", "embedding", F.col("label").alias("kind"),
        (F.col("label") >= 4).cast("double").alias("label"), MD.vector_of("embedding").alias("features"),
    )


@query("v6_batch_score", f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {WEIGHTS_SQL}) + 0.1, 6) AS score FROM embeddings")
def v6(spark, sf):
    df = table(spark, sf, "embeddings", "vec_id", "embedding")
    engine = scorer.engine("linear", "embedding", WEIGHTS, 0.1)
    out = scorer.batch_score(df, engine, "vec_id bigint, embedding array<float>, score double, prediction int")
    return out.select("vec_id", r6("score"))


@query("v6b_linear_expression", f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {WEIGHTS_SQL}) + 0.1, 6) AS score FROM embeddings")
def v6b(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", r6(scorer.linear_score(F.col("embedding"), WEIGHTS, 0.1), "score"))


@query(
    "v8_knn_regress",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rn FROM e a CROSS JOIN e b)
SELECT vec_id, round(avg(label), 6) AS prediction FROM d WHERE rn <= 5 GROUP BY vec_id""",
)
def v8(spark, sf):
    df = table(spark, sf, "embeddings")
    return MD.knn_regress(df, df, 5).select("vec_id", r6("prediction"))


@query("v8b_voting_average")
def v8b(spark, sf):
    """Mean of the 5-neighbour and the 50-tree forest predictions."""
    df = vecs(spark, sf).withColumn("label", F.col("kind").cast("double"))
    forest = MD.fit_forest(df, trees=50).transform(df).select("vec_id", "prediction")
    near = MD.knn_regress(df, df, 5)
    return MD.voting_average([near, forest], "vec_id").select("vec_id", r6("prediction"))


@query("v7_fit_logistic")
def v7(spark, sf):
    df = vecs(spark, sf)
    model = MD.fit_logistic(df, maxIter=30)
    scored = MD.positive_probability(model.transform(df))
    return scored.select("vec_id", big("label"), r6("score"), big("prediction"))


# A model of one 0/1 feature that may fit freely gives each value its share of positives.
ONE_FLAG = "(SELECT (d.n_chars > 2000)::INT AS flag, l.quality AS y FROM documents d JOIN labels l USING (doc_id))"


def flagged(spark, sf):
    df = essays(spark, sf).join(table(spark, sf, "documents", "doc_id", "n_chars"), "doc_id")
    flag = (F.col("n_chars") > 2000).cast("int")
    return MD.assemble_features(df.select(flag.alias("flag"), F.col("label").cast("double").alias("label")), ["flag"])


@query("v7b_logistic_closed_form", f"SELECT flag, count(*) AS n, round(avg(y), 4) AS score FROM {ONE_FLAG} GROUP BY flag")
def v7b(spark, sf):
    df = flagged(spark, sf)
    scored = MD.positive_probability(MD.fit_logistic(df, maxIter=200, tol=1e-12).transform(df))
    return scored.groupBy("flag").agg(F.count("*").alias("n"), F.round(F.max("score"), 4).alias("score"))


@query("v9c_boosted_one_split", f"SELECT flag, round(avg(y), 6) AS prediction FROM {ONE_FLAG} GROUP BY flag")
def v9c(spark, sf):
    df = flagged(spark, sf)
    scored = MD.fit_boosted_trees(df, rounds=1, maxDepth=1).transform(df)
    return scored.groupBy("flag").agg(r6(F.max("prediction"), "prediction"))


# Two rounds of one split over two 0/1 features: the second fits twice what the first leaves and counts a tenth.
@query(
    "v9d_boosted_two_rounds",
    """WITH x AS (SELECT (d.n_chars > 2000)::INT AS a, (d.n_chars > 600)::INT AS b, l.quality AS y FROM documents d JOIN labels l USING (doc_id)),
one AS (SELECT a, b, y, avg(y) OVER (PARTITION BY a) AS pa, avg(y) OVER (PARTITION BY b) AS pb FROM x),
first AS (SELECT a, b, y, CASE WHEN (SELECT sum((y - pa) ** 2) <= sum((y - pb) ** 2) FROM one) THEN pa ELSE pb END AS p FROM one),
two AS (SELECT *, 2 * (y - p) AS r FROM first),
means AS (SELECT *, avg(r) OVER (PARTITION BY a) AS ra, avg(r) OVER (PARTITION BY b) AS rb FROM two)
SELECT a, b, count(*) AS n, round(any_value(p) + 0.1 * any_value(CASE WHEN (SELECT sum((r - ra) ** 2) <= sum((r - rb) ** 2) FROM means) THEN ra ELSE rb END), 6) AS prediction
FROM means GROUP BY a, b""",
)
def v9d(spark, sf):
    flags = [(F.col("n_chars") > 2000).cast("int").alias("a"), (F.col("n_chars") > 600).cast("int").alias("b")]
    rows = essays(spark, sf).join(table(spark, sf, "documents", "doc_id", "n_chars"), "doc_id")
    df = MD.assemble_features(rows.select(*flags, F.col("label").cast("double").alias("label")), ["a", "b"])
    scored = MD.fit_boosted_trees(df, rounds=2, maxDepth=1).transform(df)
    return scored.groupBy("a", "b").agg(F.count("*").alias("n"), r6(F.max("prediction"), "prediction"))


@query(
    "v8c_voting_of_tables",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rn FROM e a CROSS JOIN e b),
k AS (SELECT vec_id, avg(label) FILTER (WHERE rn <= 3) AS a, avg(label) FILTER (WHERE rn <= 7) AS b FROM d GROUP BY vec_id)
SELECT vec_id, round((a + b + label) / 3, 6) AS prediction FROM k JOIN e USING (vec_id)""",
)
def v8c(spark, sf):
    df = table(spark, sf, "embeddings")
    own = df.select("vec_id", F.col("label").cast("double").alias("prediction"))
    return MD.voting_average([MD.knn_regress(df, df, 3), MD.knn_regress(df, df, 7), own], "vec_id").select("vec_id", r6("prediction"))


@query("v9_fit_boosted_trees")
def v9(spark, sf):
    """Boosted regression with the error on a held-out fifth."""
    df = vecs(spark, sf).withColumn("label", F.col("kind").cast("double"))
    parts = sampling.split(df, [0.8, 0.2], 1, key="vec_id", names=["train", "test"])
    model = MD.fit_boosted_trees(parts.where("part = 'train'"), rounds=100, maxDepth=3)
    return MD.rmse(model.transform(parts.where("part = 'test'")))


@query("v9b_fit_boosted_classes")
def v9b(spark, sf):
    """Three classes, one boosted classifier each."""
    df = vecs(spark, sf).withColumn("label", (F.col("kind") % 3).cast("double"))
    model = MD.fit_boosted_classes(df, rounds=3)
    return E.accuracy(model.transform(df))


FEATURES = ["n_chars", "n_words", "n_marks"]


def small_features(spark, sf):
    """A few numeric columns of labelled documents."""
    docs = table(spark, sf, "documents", "doc_id", "text", "n_chars")
    labels = table(spark, sf, "labels", "doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id").select(
        "doc_id", "label", F.col("n_chars").cast("double").alias("n_chars"),
        F.size(X.words("text")).cast("double").alias("n_words"),
        F.regexp_count("text", F.lit("[.?!,]")).cast("double").alias("n_marks"),
    )


@query("v10_fit_additive_boosting")
def v10(spark, sf):
    df = written(small_features(spark, sf), "v10")
    model = AD.fit_additive_boosting(df, FEATURES, bins=8, rounds=10, pairs=[("n_chars", "n_marks")])
    scored = AD.predict_additive(df, model)
    return scored.select("doc_id", big("label"), r6("score"))


@query("v10b_additive_model_table")
def v10b(spark, sf):
    df = written(small_features(spark, sf), "v10b")
    model = AD.fit_additive_boosting(df, FEATURES, bins=8, rounds=4, cyclic=True)
    return model.to_table(spark).select("term", "bin", r6("score"))


def _one_feature_sql() -> str:
    """One Newton step of a one-feature model, written out."""
    return """WITH x AS (SELECT l.quality AS y, least(3, d.n_chars // 1000) AS bin FROM documents d JOIN labels l USING (doc_id)),
p AS (SELECT avg(y) AS p FROM x)
SELECT 'big' AS term, bin::INT AS bin, round(sum(y - p) / (count(*) * any_value(p) * (1 - any_value(p))), 6) AS score FROM x, p GROUP BY bin
UNION ALL SELECT 'big', max(bin)::INT + 1, 0.0 FROM x
UNION ALL SELECT 'intercept', 0, round(ln(p / (1 - p)), 6) FROM p"""


@query("v10c_additive_one_step", _one_feature_sql())
def v10c(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "n_chars")
    labels = table(spark, sf, "labels", "doc_id", F.col("quality").alias("label"))
    df = docs.join(labels, "doc_id").select("label", F.least(F.lit(3), F.floor(F.col("n_chars") / 1000)).alias("big"))
    model = AD.fit_additive_boosting(df, ["big"], bins=400, rounds=1, lr=1.0)
    return model.to_table(spark).select("term", "bin", r6("score"))


@query(
    "v10d_additive_two_steps",
    """WITH x AS (SELECT l.quality AS y, least(3, d.n_chars // 1000) AS bin FROM documents d JOIN labels l USING (doc_id)),
p AS (SELECT avg(y) AS p FROM x),
one AS (SELECT bin, any_value(p) AS p, sum(y - p) / (count(*) * any_value(p) * (1 - any_value(p))) AS s, count(*) AS n, sum(y) AS y FROM x, p GROUP BY bin),
two AS (SELECT bin, s, n, y, 1 / (1 + exp(-(ln(p / (1 - p)) + s))) AS q FROM one)
SELECT 'big' AS term, bin::INT AS bin, round(s + (y - n * q) / (n * q * (1 - q)), 5) AS score FROM two
UNION ALL SELECT 'big', max(bin)::INT + 1, 0.0 FROM x
UNION ALL SELECT 'intercept', 0, round(ln(p / (1 - p)), 5) FROM p""",
)
def v10d(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "n_chars")
    labels = table(spark, sf, "labels", "doc_id", F.col("quality").alias("label"))
    df = docs.join(labels, "doc_id").select("label", F.least(F.lit(3), F.floor(F.col("n_chars") / 1000)).alias("big"))
    model = AD.fit_additive_boosting(df, ["big"], bins=400, rounds=2, lr=1.0)
    return model.to_table(spark).select("term", "bin", (F.round("score", 5) + 0.0).alias("score"))


@query(
    "v10e_additive_leaf_limit",
    """WITH x AS (SELECT l.quality AS y, dense_rank() OVER (ORDER BY least(9, d.n_chars // 400)) - 1 AS bin FROM documents d JOIN labels l USING (doc_id)),
p AS (SELECT avg(y) AS p, max(bin) AS top FROM x),
cells AS (SELECT bin, sum(y - p) AS g, sum(p * (1 - p)) AS h, count(*) AS n FROM x, p GROUP BY bin),
one AS (SELECT c.bin AS cut FROM cells c JOIN cells d ON true GROUP BY c.bin
  HAVING sum(d.n) FILTER (WHERE d.bin <= c.bin) >= 5 AND sum(d.n) FILTER (WHERE d.bin > c.bin) >= 5
  ORDER BY round(sum(d.g) FILTER (WHERE d.bin <= c.bin) ** 2 / sum(d.h) FILTER (WHERE d.bin <= c.bin)
    + sum(d.g) FILTER (WHERE d.bin > c.bin) ** 2 / sum(d.h) FILTER (WHERE d.bin > c.bin), 9) DESC, c.bin LIMIT 1),
two AS (SELECT c.bin AS cut FROM cells c, one JOIN cells d ON (d.bin <= one.cut) = (c.bin <= one.cut) GROUP BY c.bin
  HAVING sum(d.n) FILTER (WHERE d.bin <= c.bin) >= 5 AND sum(d.n) FILTER (WHERE d.bin > c.bin) >= 5
  ORDER BY round(sum(d.g) FILTER (WHERE d.bin <= c.bin) ** 2 / sum(d.h) FILTER (WHERE d.bin <= c.bin)
    + sum(d.g) FILTER (WHERE d.bin > c.bin) ** 2 / sum(d.h) FILTER (WHERE d.bin > c.bin) - sum(d.g) ** 2 / sum(d.h), 9) DESC, c.bin LIMIT 1),
leaves AS (SELECT c.*, (SELECT count(*) FROM (SELECT cut FROM one UNION ALL SELECT cut FROM two) WHERE cut < c.bin) AS leaf FROM cells c)
SELECT 'big' AS term, bin::INT AS bin, round(sum(g) OVER (PARTITION BY leaf) / sum(h) OVER (PARTITION BY leaf), 6) AS score FROM leaves
UNION ALL SELECT 'big', top::INT + 1, 0.0 FROM p
UNION ALL SELECT 'intercept', 0, round(ln(p / (1 - p)), 6) FROM p""",
)
def v10e(spark, sf):
    """One round whose tree has three leaves of at least five rows."""
    docs = table(spark, sf, "documents", "doc_id", "n_chars")
    labels = table(spark, sf, "labels", "doc_id", F.col("quality").alias("label"))
    df = docs.join(labels, "doc_id").select("label", F.least(F.lit(9), F.floor(F.col("n_chars") / 400)).alias("big"))
    model = AD.fit_additive_boosting(df, ["big"], bins=400, rounds=1, lr=1.0, max_leaves=3, min_samples_leaf=5)
    return model.to_table(spark).select("term", "bin", r6("score"))


@query("v10f_additive_interactions")
def v10f(spark, sf):
    """Boosting until the held-out loss stays, then the strongest pair: importance of every term."""
    df = written(small_features(spark, sf), "v10f")
    model = AD.fit_additive_boosting(
        df, FEATURES, bins=16, rounds=100, lr=0.2, max_leaves=3, min_samples_leaf=2, interactions=1, patience=5, tolerance=1e-4
    )
    return AD.term_importance(AD.explain_additive(df, model, "doc_id")).select("term", r6("importance"))


MODEL = AD.AdditiveModel(
    ["n_chars", "n_marks"], {"n_chars": [500.0, 2000.0], "n_marks": [10.0]}, -0.5, [("n_chars", "n_marks")],
    # the last bin of each feature is for missing values
    {"n_chars": [-0.4, 0.1, 0.7, 0.0], "n_marks": [0.2, -0.3, 0.0],
     "n_chars & n_marks": [0.01, 0.02, 0.0, 0.03, 0.04, 0.0, 0.05, 0.06, 0.0, 0.0, 0.0, 0.0]},
)
CONTRIB = """f AS (SELECT doc_id, n_chars, len(regexp_extract_all(text, '[.?!,]')) AS n_marks FROM documents),
b AS (SELECT doc_id, CASE WHEN n_chars <= 500 THEN 0 WHEN n_chars <= 2000 THEN 1 ELSE 2 END AS a, CASE WHEN n_marks <= 10 THEN 0 ELSE 1 END AS m FROM f),
c AS (SELECT doc_id, 'n_chars' AS term, [-0.4::DOUBLE, 0.1, 0.7][a + 1] AS contribution FROM b
  UNION ALL SELECT doc_id, 'n_marks', [0.2::DOUBLE, -0.3][m + 1] FROM b
  UNION ALL SELECT doc_id, 'n_chars & n_marks', (a * 2 + m + 1) / 100.0 FROM b)"""


def marked(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars", F.regexp_count("text", F.lit("[.?!,]")).alias("n_marks"))


@query("v11_explain_additive", f"WITH {CONTRIB} SELECT doc_id, term, round(contribution, 6) AS contribution FROM c")
def v11(spark, sf):
    return AD.explain_additive(marked(spark, sf), MODEL, "doc_id").select("doc_id", "term", r6("contribution"))


@query("v11b_term_importance", f"WITH {CONTRIB} SELECT term, round(avg(abs(contribution)), 6) AS importance FROM c GROUP BY term")
def v11b(spark, sf):
    return AD.term_importance(AD.explain_additive(marked(spark, sf), MODEL, "doc_id")).select("term", r6("importance"))


@query("v12_random_search")
def v12(spark, sf):
    df = vecs(spark, sf).select("features", "label")
    grid = {"regParam": [0.0, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5], "maxIter": [5, 10]}
    found = MD.random_search(df, LogisticRegression(), grid, n_iter=10, folds=3)
    return P.best_trial(MD.search_results(found, spark)).select("trial", "params", r6("auc"))


GRID = {"learning_rate": [0.05, 0.1, 0.3, 0.5], "max_rounds": [5, 10, 15, 20], "min_samples_leaf": [2, 3, 5], "max_leaves": [3, 5, 10]}


@query("v12b_search_additive")
def v12b(spark, sf):
    """Random search over the additive model, best point first."""
    _model, trials = AD.search_additive(small_features(spark, sf), FEATURES, GRID, n_iter=10, folds=3)
    return P.best_trial(trials).select("trial", "params", r6("auc"))


# With one yes-or-no feature every point ranks a fold's rows by the rate of their value in the other folds.
ONE_ROUND = {**GRID, "max_rounds": [1]}
_POINTS = ", ".join(f"({i}, '{str(sorted(AD._grid_point(p).items())).replace(chr(39), chr(39) * 2)}')" for i, p in enumerate(MD.sample_grid(ONE_ROUND, 10, 314)))


@query(
    "v12c_search_trials",
    f"""WITH x AS (SELECT l.quality AS y, (d.n_chars > 1000)::INT AS v, floor({draw_sql('d.doc_id', 314)} * 3) AS fold FROM documents d JOIN labels l USING (doc_id)),
cells AS (SELECT fold, v, sum(y) AS pos, sum(1 - y) AS neg FROM x GROUP BY fold, v),
whole AS (SELECT v, sum(y) AS pos, sum(1 - y) AS neg FROM x GROUP BY v),
folds AS (SELECT c.fold, c.v, c.pos, c.neg, (w.pos - c.pos) / (w.pos - c.pos + w.neg - c.neg) AS rate FROM cells c JOIN whole w USING (v)),
aucs AS (SELECT a.fold, sum(a.pos * b.neg * CASE WHEN a.rate > b.rate THEN 1 WHEN a.rate = b.rate THEN 0.5 ELSE 0 END) / (max(p) * max(n)) AS auc
  FROM folds a JOIN folds b USING (fold) JOIN (SELECT fold, sum(pos) AS p, sum(neg) AS n FROM folds GROUP BY fold) USING (fold) GROUP BY a.fold)
SELECT trial, params, round(avg(auc), 6) AS auc, 1 AS rounds FROM aucs, (VALUES {_POINTS}) AS t(trial, params) GROUP BY trial, params""",
)
def v12c(spark, sf):
    """Every trial of a search of ten points over three folds."""
    docs = table(spark, sf, "documents", "doc_id", "n_chars")
    labels = table(spark, sf, "labels", "doc_id", F.col("quality").alias("label"))
    df = docs.join(labels, "doc_id").select("doc_id", "label", (F.col("n_chars") > 1000).cast("double").alias("v"))
    _model, trials = AD.search_additive(df, ["v"], ONE_ROUND, n_iter=10, folds=3)
    return trials.select("trial", "params", r6("auc"), "rounds")


@query("v13_assemble_features", "SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS f0, round(l_discount, 6) AS f1 FROM lineitem")
def v13(spark, sf):
    df = MD.assemble_features(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"])
    arr = MD.vector_to_array("features")
    return df.select("l_orderkey", "l_linenumber", r6(arr[0], "f0"), r6(arr[1], "f1"))


@query(
    "v14_pool_concat",
    "SELECT vec_id, len(p)::INT AS n, round(p[1]::DOUBLE, 6) AS first, round(p[128]::DOUBLE, 6) AS last FROM (SELECT vec_id, list_concat(embedding, list_reverse(embedding)) AS p FROM embeddings)",
)
def v14(spark, sf):
    p = vectors.pool_concat("embedding", F.reverse("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", p.alias("p")).select(
        "vec_id", F.size("p").alias("n"), r6(F.get("p", F.lit(0)), "first"), r6(F.get("p", F.lit(127)), "last")
    )


@query("s8_save_load_model", "SELECT vec_id, true AS same FROM embeddings")
def s8(spark, sf):
    """Scores of a saved and loaded model next to those of the model itself."""
    df = vecs(spark, sf)
    root = fresh_path(spark, "models")
    model = Pipeline(stages=[LogisticRegression(maxIter=20)]).fit(df)
    sinks.save_model(model, root, "m1", "logistic", ["test"])
    own = MD.positive_probability(model.transform(df)).select("vec_id", F.col("score").alias("own"))
    loaded = MD.positive_probability(sinks.load_model(spark, root, "m1").transform(df)).select("vec_id", "score")
    return own.join(loaded, "vec_id").select("vec_id", (F.col("own") == F.col("score")).alias("same"))


# -- the scoring contract ---------------------------------------------------

@query(
    "f1_scorer_contract",
    "SELECT doc_id, (2 * length(text) + 1)::DOUBLE AS score, 'seen=' || length(text) AS stats FROM documents",
)
def f1(spark, sf):
    class LengthScorer(scorer.Scorer):
        def load(self, path):
            return {"slope": 2.0}

        def preprocess(self, batch):
            return batch.assign(state_len=batch["text"].str.len())

        def process(self, batch, model):
            return batch.assign(score=batch["state_len"] * model["slope"] + 1.0)

        def postprocess(self, batch):
            return batch.assign(stats=[{"seen": str(n)} for n in batch["state_len"]])[["doc_id", "score", "stats"]]

    scorer.register_engine("length", LengthScorer)
    out = scorer.batch_score(
        table(spark, sf, "documents", "doc_id", "text"), scorer.engine("length"), "doc_id bigint, score double, stats map<string,string>"
    )
    return out.select("doc_id", "score", F.concat(F.lit("seen="), F.col("stats")["seen"]).alias("stats"))


@query("f2_engine_registry", "SELECT vec_id, len(embedding)::INT AS width FROM embeddings")
def f2(spark, sf):
    width = scorer.engine("custom", lambda batch: batch.assign(width=batch["embedding"].map(len).astype("int32"))[["vec_id", "width"]])
    return scorer.batch_score(table(spark, sf, "embeddings", "vec_id", "embedding"), width, "vec_id bigint, width int")


@query("f3_text_function", "SELECT doc_id, length(text)::BIGINT AS n FROM documents")
def f3(spark, sf):
    measure = scorer.text_function(lambda s: s.str.len(), "bigint")
    return table(spark, sf, "documents").select("doc_id", measure("text").alias("n"))


@query("f4_row_to_rows", f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({S.tokens('text')}) AS token FROM documents) GROUP BY ALL")
def f4(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(X.tokenize("text")).alias("token"))
    return rows.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("f6_chained_steps", "SELECT DISTINCT text, 1 AS label, 'src' AS source FROM documents")
def f6(spark, sf):
    steps = (
        table(spark, sf, "documents")
        .transform(P.with_literal, "label", 1)
        .transform(P.with_literal, "source", "src")
        .transform(P.distinct_rows, ["text", "label", "source"])
    )
    root = fresh_path(spark, "steps")
    return sinks.read_dataset_version(spark, root, "step", sinks.write_dataset_version(steps, root, "step"))


# -- whole plans ------------------------------------------------------------

PICKED = ("textual_entropy", "semantic_density", "num_tokens", "max_depth", "unique_rules", "gunning_fog", "dale_chall", "depth_variability")
DRAWS = f"""e AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {draw_hex_sql('doc_id', 42)}, doc_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM {ESSAYS_SQL}),
d AS (SELECT DISTINCT label, n, unnest(range(1, 101)) AS draw_no FROM e),
a AS (SELECT label, draw_no, floor({draw_sql("(label || '/' || draw_no)", 42)} * n)::BIGINT + 1 AS rn FROM d),
picks AS (SELECT e.doc_id, a.label, a.draw_no FROM a JOIN e USING (label, rn))"""


def _pipeline(spark, sf, scale):
    root = fresh_path(spark, "pipeline")
    version = features_pipeline(
        essays(spark, sf), lexicon(spark, sf), familiar(spark, sf), root, "features", scale=scale, per_label=100
    )
    return sinks.read_dataset_version(spark, root, "features", version)


@query(
    "plan_features_pipeline",
    f"""WITH {DRAWS}, f AS ({feature_sql()})
SELECT p.doc_id, p.label, p.draw_no, {', '.join('f.' + c for c in PICKED)} FROM picks p JOIN f USING (doc_id)""",
)
def plan_features(spark, sf):
    out = _pipeline(spark, sf, False)
    return out.select("doc_id", "label", big("draw_no"), *[F.col(c) if c in INTS else r6(c) for c in PICKED])


@query(
    "plan_scaled_features",
    f"""WITH {DRAWS}, f AS ({feature_sql(raw=True)}), j AS (SELECT p.doc_id, p.draw_no, {', '.join('f.' + c for c in PICKED)} FROM picks p JOIN f USING (doc_id))
SELECT doc_id, draw_no, {', '.join(f'round(({c} - min({c}) FILTER (WHERE NOT isnan({c}::DOUBLE)) OVER ()) / (max({c}) FILTER (WHERE NOT isnan({c}::DOUBLE)) OVER () - min({c}) FILTER (WHERE NOT isnan({c}::DOUBLE)) OVER ()), 4) AS {c}_scaled' for c in PICKED)} FROM j""",
)
def plan_scaled(spark, sf):
    out = _pipeline(spark, sf, True)
    return out.select("doc_id", big("draw_no"), *[F.round(f"{c}_scaled", 4).alias(f"{c}_scaled") for c in PICKED])


@query(
    "plan_score_requests",
    f"""WITH r AS (SELECT conv_id, turn, role, {S.clean('text', 'serving')} AS t, {draw_sql("(conv_id || '-' || turn)", 3)} AS u FROM conversations),
x AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN CASE WHEN u < 0.25 THEN 'user/2' ELSE 'user/1' END ELSE role END AS url, len({S.words('t')}) AS w FROM r)
SELECT conv_id, turn, url, CASE url WHEN 'user/1' THEN 'm1' WHEN 'user/2' THEN 'm2' WHEN 'assistant' THEN 'm3' END AS model_id,
  round(w / (w + 40.0::DOUBLE), 6) AS score, CASE WHEN w < 40 THEN 'human' WHEN w > 40 THEN 'LLM' END AS verdict
FROM x WHERE url <> 'system'""",
)
def plan_score(spark, sf):
    reqs = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.col("role").alias("url"), "text"
    )
    targets = spark.createDataFrame([("user", 1, "user/2", 0.25), ("user", 2, "user/1", 0.75)], "endpoint string, ord int, target string, weight double")
    static = spark.createDataFrame([("user/1", "m1"), ("user/2", "m2")], "url string, model_id string")
    monitored = spark.createDataFrame([("assistant", "m3")], "url string, model_id string")
    words = F.size(X.words("clean")).cast("double")
    out = scoring.score_requests(reqs, targets, static, monitored, words / (words + 40.0), seed=3)
    return out.select("conv_id", "turn", F.col("routed").alias("url"), "model_id", r6("score"), "verdict")


SCORED = f"""r AS (SELECT conv_id, turn, role, {S.clean('text', 'serving')} AS t, {draw_sql("(conv_id || '-' || turn)", 3)} AS u FROM conversations),
x AS (SELECT CASE WHEN role = 'user' THEN CASE WHEN u < 0.25 THEN 'user/2' ELSE 'user/1' END ELSE role END AS url, len({S.words('t')}) AS w FROM r)"""


@query(
    "plan_score_stream",
    f"""WITH {SCORED} SELECT url, CASE WHEN w < 40 THEN 'human' WHEN w > 40 THEN 'LLM' ELSE '' END AS verdict, count(*) AS scored, count(*) AS logged,
  sum(0.25::DOUBLE) AS latency FROM x WHERE url <> 'system' GROUP BY ALL""",
)
def plan_stream(spark, sf):
    """Scored rows and the statistics messages of the same stream, counted side by side."""
    schema = table(spark, sf, "conversations").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/conversations.parque[t]")
    reqs = raw.select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.col("role").alias("url"), "text", F.lit(0.25).alias("latency"))
    targets = spark.createDataFrame([("user", 1, "user/2", 0.25), ("user", 2, "user/1", 0.75)], "endpoint string, ord int, target string, weight double")
    static = spark.createDataFrame([("user/1", "m1"), ("user/2", "m2")], "url string, model_id string")
    monitored = spark.createDataFrame([("assistant", "m3")], "url string, model_id string")
    words = F.size(X.words("clean")).cast("double")
    root = scoring.score_stream(reqs, targets, static, monitored, words / (words + 40.0), 3, max_bytes=8000)
    scored = spark.read.parquet(f"{root}/scored").groupBy(F.col("routed").alias("url"), F.coalesce("verdict", F.lit("")).alias("verdict")).agg(F.count("*").alias("scored"))
    events = stats.unpack_events(spark.read.text(f"{root}/messages"))
    e = F.col("event")
    logged = events.groupBy(e["_url"].alias("url"), e["verdict"].alias("verdict")).agg(
        F.count("*").alias("logged"), F.sum(e["_latency"].cast("double")).alias("latency")
    )
    return scored.join(logged, ["url", "verdict"])


@query(
    "plan_score_features",
    f"""WITH f AS ({feature_sql(raw=True)}) SELECT doc_id, d.lang AS url, round(semantic_density, 6) AS score,
  CASE WHEN semantic_density < 0.5 THEN 'human' WHEN semantic_density > 0.5 THEN 'LLM' END AS verdict,
  num_tokens::DOUBLE AS num_tokens, round(textual_entropy, 6) AS textual_entropy, {len(dict.fromkeys(FEATURE_NAMES))} AS n
FROM f JOIN documents d USING (doc_id)""",
)
def plan_score_feats(spark, sf):
    reqs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("url"), "text")
    out = scoring.score_features(
        reqs, lexicon(spark, sf), familiar(spark, sf), lambda f: f.withColumn("score", F.col("semantic_density")), key="doc_id"
    )
    m = F.col("features")
    return out.select(
        "doc_id", "url", r6("score"), "verdict", m["num_tokens"].alias("num_tokens"), r6(m["textual_entropy"], "textual_entropy"), F.size(m).alias("n")
    )


REPLY_SQL = f"""WITH {VOCAB}, serving AS (SELECT doc_id, {S.clean('text', 'serving')} AS t FROM documents),
cut AS (SELECT doc_id, unnest(list_slice({S.tokens('lower(t)')}, 1, 126)) AS token FROM serving),
ids AS (SELECT doc_id, count(*) FILTER (WHERE coalesce(v.token_id, 1) = 1) * 0.01::DOUBLE AS a, count(*) FILTER (WHERE v.token_id > 3) * 0.02::DOUBLE AS b
  FROM cut LEFT JOIN vocab v USING (token) GROUP BY doc_id),
y AS (SELECT d.doc_id, coalesce(a, 0.0) AS a, coalesce(b, 0.0) AS b FROM documents d LEFT JOIN ids USING (doc_id)),
z AS (SELECT *, exp(b) / (exp(a) + exp(b)) AS p FROM y),
f AS ({feature_sql(raw=True).replace(S.CLEAN, f"clean AS (SELECT doc_id, {S.clean('text', 'serving')} AS t FROM documents)")})
SELECT z.doc_id, (b > a)::INT AS label, round(exp(p) / (exp(1 - p) + exp(p)), 6) AS probability, round((num_tokens - 10) / 490.0::DOUBLE, 6) AS num_tokens,
  round(textual_entropy / 8.0::DOUBLE, 6) AS textual_entropy, round(semantic_density, 6) AS semantic_density FROM z JOIN f USING (doc_id)"""


def _reply(spark, sf):
    scaler = spark.createDataFrame(
        [("num_tokens", 10.0, 500.0, 0.0, 1.0), ("textual_entropy", 0.0, 8.0, 0.0, 1.0)], "col string, min double, max double, mean double, std double"
    )
    vocab = build_vocab(docs(spark, sf), 2000)
    lex, known = lexicon(spark, sf), familiar(spark, sf)

    def counted(ids):
        unknown, named = (F.size(F.filter("input_ids", f)).cast("double") for f in (lambda x: x == 1, lambda x: x > 3))
        return ids.withColumn("logits", F.array(unknown * 0.01, named * 0.02))

    return lambda rows: scoring.score_reply(rows, vocab, counted, lex, known, scaler, key="doc_id")


def _reply_columns(df):
    f = F.col("features")
    return df.select("doc_id", F.col("label").cast("int").alias("label"), r6("probability"), *[r6(f[c], c) for c in ("num_tokens", "textual_entropy", "semantic_density")])


@query("plan_score_reply", REPLY_SQL)
def plan_reply(spark, sf):
    return _reply_columns(_reply(spark, sf)(table(spark, sf, "documents", "doc_id", "text")))


@query("plan_score_reply_stream", REPLY_SQL)
def plan_reply_stream(spark, sf):
    schema = table(spark, sf, "documents").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]").select("doc_id", "text")
    root = fresh_path(spark, "reply")
    scoring.start_reply_stream(raw, _reply(spark, sf), root).awaitTermination()
    return _reply_columns(spark.read.parquet(f"{root}/replies"))


@query("plan_train_evaluate")
def plan_train(spark, sf):
    """Balanced sample, split, random search, refit and evaluation on the held-out part."""
    df = written(small_features(spark, sf), "train")
    return training.train_and_evaluate(df, FEATURES, per_label=50, n_iter=2, folds=2).select(
        *[r6(c) for c in ("accuracy", "precision", "recall", "f1", "auc", "score_auc")]
    )


