import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgauge.operators import additive as AD
from inkgauge.operators import boosting as BO
from inkgauge.operators.evaluation import roc_auc


def plain_tree(g, h, n, max_leaves, least):
    """Best cut first by trying every cut of every leaf."""

    def gain(a, b):
        def part(i, j):
            return sum(g[i:j]) ** 2 / sum(h[i:j]) if sum(h[i:j]) > 1e-6 else 0.0

        return max(
            ((part(a, c) + part(c, b) - part(a, b), -c) for c in range(a + 1, b) if min(sum(n[a:c]), sum(n[c:b])) >= least),
            default=(0.0, 0),
        )

    leaves = [(0, len(g))]
    while len(leaves) < max_leaves:
        found, k = max((gain(*leaf), -i) for i, leaf in enumerate(leaves))
        if found[0] <= 1e-12:
            break
        a, b = leaves.pop(-k)
        leaves += [(a, -found[1]), (-found[1], b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        if sum(h[a:b]) > 1e-6 and sum(n[a:b]) >= least:
            out[a:b] = sum(g[a:b]) / sum(h[a:b])
    return out


@pytest.mark.parametrize("seed", range(20))
def test_trees_take_the_best_cut_first(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(0, 6, 12)
    h, g = n * rng.uniform(0.1, 0.25, 12), n * rng.normal(0, 1, 12)
    for max_leaves, least in ((1, 1), (3, 1), (4, 3), (50, 2)):
        got = BO.tree_values(np.array([g, h, n]), max_leaves, least, 1e-6)
        assert got == pytest.approx(plain_tree(g.tolist(), h.tolist(), n.tolist(), max_leaves, least))
        assert len(set(got.round(9))) <= max_leaves


def test_blocks_of_two_features_are_cut_along_both():
    sums = np.zeros((3, 4, 4))
    sums[2], sums[1] = 10, 1
    sums[0, :2, :2], sums[0, 2:, 2:], sums[0, :2, 2:], sums[0, 2:, :2] = 2.0, 2.0, -2.1, -1.9
    got = BO.tree_values(sums, 4, 1, 1e-6)
    assert got[0, 0] == pytest.approx(2.0) and got[3, 3] == pytest.approx(2.0) and got[0, 3] == pytest.approx(-2.1) and got[3, 0] == pytest.approx(-1.9)
    assert BO.quadrant_gain(sums, 1, 1e-6) > 10 and BO.quadrant_gain(sums, 41, 1e-6) == 0.0
    assert BO.quadrant_gain(np.ones((3, 1, 4)), 1, 1e-6) == 0.0


def planted(spark, n=4000):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        a, b, c, d = (rng.random() for _ in range(4))
        odds = 2.0 * ((a > 0.5) != (b > 0.4)) + 1.5 * (c > 0.7) - 1.4
        rows.append((i, a, b, c if rng.random() > 0.05 else None, d, int(rng.random() < 1 / (1 + math.exp(-2 * odds)))))
    return spark.createDataFrame(rows, "doc_id int, a double, b double, c double, d double, label int")


def test_a_planted_interaction_is_found_and_helps(spark):
    df = planted(spark)
    options = {"bins": 10, "rounds": 25, "lr": 0.4, "max_leaves": 3, "min_samples_leaf": 5}
    alone = AD.fit_additive_boosting(df, ["a", "b", "c", "d"], **options)
    model = AD.fit_additive_boosting(df, ["a", "b", "c", "d"], interactions=1, **options)
    assert model.pairs == [("a", "b")] and alone.pairs == []
    one, two = (roc_auc(AD.predict_additive(df, m).select("label", "score")).first()["auc"] for m in (alone, model))
    assert two > one + 0.1


def test_leaves_are_limited(spark):
    df = planted(spark, 600)
    model = AD.fit_additive_boosting(df, ["a", "c"], bins=16, rounds=1, max_leaves=2, min_samples_leaf=30)
    # one cut, and missing values by themselves
    assert len(set(model.scores["a"][:-1])) <= 2 and len(set(model.scores["c"])) <= 3 and model.scores["a"][-1] == 0.0
    few = AD.fit_additive_boosting(df.limit(40), ["c"], bins=4, rounds=1, max_leaves=3, min_samples_leaf=30)
    assert set(few.scores["c"][:-1]) == {few.scores["c"][0]}


def test_early_stopping_keeps_the_best_scores(spark):
    df = planted(spark, 300).withColumn("label", (F.xxhash64("doc_id") % 2 == 0).cast("int"))
    table = AD.binned_table(df, ["a", "b"], "label", 16, (F.col("doc_id") % 3).cast("int"))
    fit = table.fit(hold=1, rounds=200, lr=1.0, patience=3, tolerance=0.0)
    BO.advance(table.rows, [fit], 2)
    assert not fit.running and fit.done < 60
    assert min(fit.losses) == pytest.approx(fit.best[0]) and fit.losses[fit.best[1]] == fit.best[0]
    assert all((x == y).all() for x, y in zip(fit.scores, fit.best[2]))


def test_points_advance_together_as_they_would_alone(spark):
    df = planted(spark, 900)
    grid = {"learning_rate": [0.1, 0.3, 0.6], "max_rounds": [3, 7], "min_samples_leaf": [2, 5], "max_leaves": [2, 3, 5]}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("search", "search")
    _model, trials = AD.search_additive(df, ["a", "b", "c"], grid, n_iter=6, folds=3, seed=3)
    found = trials.collect()
    jobs = len(tracker.getJobIdsForGroup("search"))
    spark.sparkContext.setJobGroup("alone", "alone")
    from inkgauge.operators.models import sample_grid

    for row, point in zip(found, sample_grid(grid, 6, 3)):
        point = AD._grid_point(point)
        aucs = []
        for k in range(3):
            table = AD.binned_table(df, ["a", "b", "c"], "label", 16, F.floor(AD.draw("doc_id", 3) * 3).cast("int"))
            fit = table.fit(hold=k, **point)
            BO.advance(table.rows, [fit], 3)
            scored = AD.predict_additive(df.where(F.floor(AD.draw("doc_id", 3) * 3) == k), table.model(fit))
            aucs.append(roc_auc(scored.select("label", F.round("raw", 9).alias("score"))).first()["auc"])
        assert row["auc"] == pytest.approx(sum(aucs) / 3) and row["rounds"] == point["rounds"]
    # scans of the longest point and its refit, and a few jobs around them
    assert jobs < 60


def test_halving_ends_the_weaker_points(spark):
    df = planted(spark, 600)
    grid = {"lr": [0.001, 0.002, 0.4, 0.5], "rounds": [8]}
    model, trials = AD.search_additive(df, ["a", "c"], grid, n_iter=4, folds=2, halving=1)
    rounds = {r["params"]: r["rounds"] for r in trials.collect()}
    assert sorted(rounds.values()) == [4, 4, 8, 8]
    assert all(n == 8 for p, n in rounds.items() if "0.4" in p or "0.5" in p)
    with pytest.raises(ValueError, match="unknown parameters"):
        AD.search_additive(df, ["a"], {"depth": [1]}, n_iter=1)
