import random

import pytest

from inkgauge.operators import evaluation as E


def frame(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int")


def test_undefined_ratios(spark):
    none = E.binary_metrics(frame(spark, [(0, 0), (0, 0)])).first()
    assert (none["precision"], none["recall"], none["f1"], none["accuracy"]) == (1.0, 0.0, 1.0, 1.0)
    missed = E.binary_metrics(frame(spark, [(1, 0), (0, 0)])).first()
    assert (missed["precision"], missed["recall"], missed["f1"], missed["auc"]) == (1.0, 0.0, 0.0, 0.5)


def test_grid_keeps_empty_cells(spark):
    got = {(r["label"], r["prediction"]): r["n"] for r in E.confusion_matrix(frame(spark, [(1, 1)])).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 1}


def test_auc_with_ties_against_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.randint(0, 30) / 30) for _ in range(400)]
    df = spark.createDataFrame(rows, "label int, score double")
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert E.roc_auc(df).first()["auc"] == pytest.approx(want)
    curve = E.roc_curve(df).collect()
    assert len(curve) == len({s for _y, s in rows})
    assert max(r["tpr"] for r in curve) == 1.0 == max(r["fpr"] for r in curve)


def test_all_equal_scores(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.5), (1, 0.5)], "label int, score double")
    assert E.roc_auc(df).first()["auc"] == 0.5
    assert E.average_precision(df).first()["average_precision"] == pytest.approx(2 / 3)


def test_one_class(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.5)], "label int, score double")
    assert E.roc_auc(df).first()["auc"] == 0.0
    assert E.pr_curve(df).count() == 2


def test_missing_scores_are_no_points_of_a_curve(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.4), (1, None), (0, float("nan")), (None, 0.95)], "label int, score double")
    rows = E.roc_curve(df).orderBy("threshold").collect()
    assert [(r["threshold"], r["tp"], r["fp"]) for r in rows] == [(0.4, 1, 1), (0.9, 1, 0)]
    assert E.roc_auc(df).first()["auc"] == 1.0 and E.pr_curve(df).count() == 2
