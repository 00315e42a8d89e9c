"""Training and evaluation: balanced sample, split, random search, refit, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluation import binary_metrics, roc_auc
from ..operators.models import assemble_features, positive_probability, random_search
from ..operators.sampling import sample_per_label, split
from ..session import written

GRID = {
    "regParam": [0.0, 0.01, 0.1, 1.0],
    "elasticNetParam": [0.0, 0.5, 1.0],
    "maxIter": [10, 20, 50],
}


def train_and_evaluate(
    df: DataFrame, features: Sequence[str], per_label: int, n_iter: int = 10, folds: int = 3, test: float = 0.2,
    seed: int = 42, label: str = "label", key: str = "doc_id",
) -> DataFrame:
    """One row of metrics on the held-out part, with the AUC of the scores."""
    sample = sample_per_label(df, per_label, seed, label, key)
    parts = split(written(sample, "sample"), [1.0 - test, test], seed + 1, key, names=["train", "test"])
    ready = written(
        assemble_features(parts, features).withColumn("label", F.col(label).cast("double")).select(key, "part", "features", "label"),
        "ready",
    )
    found = random_search(ready.where("part = 'train'"), LogisticRegression(), GRID, n_iter, folds)
    held = written(
        positive_probability(found.bestModel.transform(ready.where("part = 'test'"))).select("label", "prediction", "score"), "held"
    )
    auc = roc_auc(held).first()["auc"]
    return binary_metrics(held).withColumn("score_auc", F.lit(auc))
