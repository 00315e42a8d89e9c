"""Classification metrics, ROC and precision-recall curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ordering import running_sums


def _n(cond: Column) -> Column:
    return F.count_if(cond)


def _ratio(a: Column, b: Column, undefined: float) -> Column:
    return F.when(b == 0, F.lit(undefined)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def confusion_matrix(df: DataFrame, labels: Sequence[int] = (0, 1), label: str = "label", pred: str = "prediction") -> DataFrame:
    """Full label x prediction grid, zeros included, in one pass."""
    cells = [(a, p) for a in labels for p in labels]
    one = df.agg(*[_n((F.col(label) == a) & (F.col(pred) == p)).alias(f"c_{a}_{p}") for a, p in cells])
    grid = F.array(
        *[F.struct(F.lit(a).alias(label), F.lit(p).alias(pred), F.col(f"c_{a}_{p}").alias("n")) for a, p in cells]
    )
    return one.select(F.inline(grid))


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """accuracy, precision, recall, f1, auc of hard 0/1 predictions.

    Undefined precision and F1 are 1, undefined recall is 0; the auc of hard
    labels is the mean of the two class recalls.
    """
    y, p = F.col(label), F.col(pred)
    c = df.agg(
        _n((y == 1) & (p == 1)).alias("tp"), _n((y == 0) & (p == 1)).alias("fp"),
        _n((y == 1) & (p == 0)).alias("fn"), _n((y == 0) & (p == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return c.select(
        _ratio(tp + tn, tp + fp + fn + tn, 0.0).alias("accuracy"),
        _ratio(tp, tp + fp, 1.0).alias("precision"),
        _ratio(tp, tp + fn, 0.0).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn, 1.0).alias("f1"),
        ((_ratio(tp, tp + fn, 0.0) + _ratio(tn, tn + fp, 0.0)) / 2).alias("auc"),
    )


def classification_report(df: DataFrame, labels: Sequence[int] = (0, 1), label: str = "label", pred: str = "prediction") -> DataFrame:
    """Per-class precision, recall, F1 and support, with macro and weighted averages."""
    y, p = F.col(label), F.col(pred)
    one = df.agg(
        *[
            F.struct(
                _n((y == v) & (p == v)).alias("tp"), _n((y != v) & (p == v)).alias("fp"), _n((y == v) & (p != v)).alias("fn")
            ).alias(f"c{v}")
            for v in labels
        ]
    )
    rows = F.array(*[F.struct(F.lit(str(v)).alias("class"), F.col(f"c{v}").alias("c")) for v in labels])
    per = one.select(F.inline(rows)).select(
        "class",
        _ratio(F.col("c.tp"), F.col("c.tp") + F.col("c.fp"), 0.0).alias("precision"),
        _ratio(F.col("c.tp"), F.col("c.tp") + F.col("c.fn"), 0.0).alias("recall"),
        _ratio(2 * F.col("c.tp"), 2 * F.col("c.tp") + F.col("c.fp") + F.col("c.fn"), 0.0).alias("f1"),
        (F.col("c.tp") + F.col("c.fn")).alias("support"),
    )
    kinds = ("precision", "recall", "f1")
    macro = per.agg(*[F.avg(k).alias(k) for k in kinds], F.sum("support").alias("support")).withColumn("class", F.lit("macro avg"))
    weighted = per.agg(
        *[(F.sum(F.col(k) * F.col("support")) / F.sum("support")).alias(k) for k in kinds], F.sum("support").alias("support")
    ).withColumn("class", F.lit("weighted avg"))
    return per.unionByName(macro).unionByName(weighted)


def accuracy(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    hit = (F.col(label) == F.col(pred)).cast("int")
    return df.agg(F.sum(hit).alias("correct"), F.count("*").alias("total"), F.avg(hit.cast("double")).alias("accuracy"))


def misclassified_rows(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    return df.where(F.col(label) != F.col(pred))


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score, written once.

    Rows without a score (null or NaN) or label are no points of a curve.

    The curve needs this table three times (range bounds, range totals, rows);
    the scored data itself is read only here.
    """
    known = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    per = known.groupBy(score).agg(_n(F.col(label) == 1).alias("_pos"), _n(F.col(label) != 1).alias("_neg"))
    return written(per.withColumn("_desc", -F.col(score).cast("double")), "scores")


def _running(per: DataFrame) -> DataFrame:
    """Running true and false positives, highest score first."""
    return running_sums(per, ["_desc"], {"tp": "_pos", "fp": "_neg"}).drop("_desc")


def threshold_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Running true and false positives per distinct score; ties share one threshold."""
    return _running(score_counts(df, label, score))


def _totals(per: DataFrame) -> tuple[Column, Column]:
    """All positives and all negatives: two numbers of an already written table."""
    p, n = per.agg(F.sum("_pos"), F.sum("_neg")).first()
    return F.lit(p or 0), F.lit(n or 0)


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """``threshold, tp, fp, tpr, fpr`` per distinct score."""
    per = score_counts(df, label, score)
    pos, neg = _totals(per)
    return _running(per).select(
        F.col(score).alias("threshold"), "tp", "fp",
        _ratio(F.col("tp"), pos, 0.0).alias("tpr"),
        _ratio(F.col("fp"), neg, 0.0).alias("fpr"),
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve; ties count half (rank statistic)."""
    pts = threshold_counts(df, label, score)
    # positives at or above each score beat its negatives; own ties count half
    wins = F.col("_neg") * (F.col("tp") - F.col("_pos") / 2.0)
    return pts.agg(
        _ratio(F.sum(wins), F.sum("_pos") * F.sum("_neg"), 0.0).alias("auc"),
        F.sum("_pos").alias("positives"),
        F.sum("_neg").alias("negatives"),
    )


def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    per = score_counts(df, label, score)
    pos, _neg = _totals(per)
    return _running(per).select(
        F.col(score).alias("threshold"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0).alias("precision"),
        _ratio(F.col("tp"), pos, 0.0).alias("recall"),
    )


def average_precision(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Sum of precision times recall step over the thresholds."""
    pts = threshold_counts(df, label, score)
    step = F.col("_pos") * _ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0)
    return pts.agg(_ratio(F.sum(step), F.sum("_pos"), 0.0).alias("average_precision"))
