"""Model fitting with MLlib, exact nearest neighbours and random search."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_dir

VECTOR = "features"
# Training rows whose least distance bounds the k-th one of a query.
GROUP = 64
# Queries whose distances to a block are held at once.
SLICE = 32


def assemble_features(df: DataFrame, columns: Sequence[str], out: str = VECTOR) -> DataFrame:
    """An ordered vector of named numeric columns; nulls stay as NaN."""
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep").transform(df)


def vector_of(array: Column | str) -> Column:
    """An MLlib vector from an array column."""
    return array_to_vector(F.col(array) if isinstance(array, str) else array)


def fit_logistic(df: DataFrame, label: str = "label", features: str = VECTOR, **params) -> PipelineModel:
    return Pipeline(stages=[LogisticRegression(labelCol=label, featuresCol=features, **params)]).fit(df)


def fit_forest(df: DataFrame, label: str = "label", features: str = VECTOR, trees: int = 50, seed: int = 42, **params) -> PipelineModel:
    stage = RandomForestRegressor(labelCol=label, featuresCol=features, numTrees=trees, seed=seed, **params)
    return Pipeline(stages=[stage]).fit(df)


def fit_boosted_trees(
    df: DataFrame, label: str = "label", features: str = VECTOR, rounds: int = 100, seed: int = 42, **params
) -> PipelineModel:
    """Squared-error boosted regression trees.

    Boosting cuts its lineage every ten rounds under the shared checkpoint folder.
    """
    work_dir(df.sparkSession)
    stage = GBTRegressor(labelCol=label, featuresCol=features, maxIter=rounds, seed=seed, lossType="squared", **params)
    return Pipeline(stages=[stage]).fit(df)


def fit_boosted_classes(
    df: DataFrame, label: str = "label", features: str = VECTOR, rounds: int = 100, seed: int = 42
) -> PipelineModel:
    """Several classes by one boosted classifier each."""
    work_dir(df.sparkSession)
    base = GBTClassifier(maxIter=rounds, seed=seed)
    return Pipeline(stages=[OneVsRest(classifier=base, labelCol=label, featuresCol=features)]).fit(df)


def fit_forest_classes(df: DataFrame, label: str = "label", features: str = VECTOR, trees: int = 50, seed: int = 42) -> PipelineModel:
    stage = RandomForestClassifier(labelCol=label, featuresCol=features, numTrees=trees, seed=seed)
    return Pipeline(stages=[stage]).fit(df)


def positive_probability(df: DataFrame, out: str = "score") -> DataFrame:
    return df.withColumn(out, vector_to_array("probability")[1])


def rmse(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.pow(F.col(label) - F.col(pred), 2))).alias("rmse"), F.count("*").alias("n"))


# -- exact nearest neighbours -----------------------------------------------

def block_search(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Finds the ``k`` nearest rows ``t, v, y`` of each query ``q, v``; tasks need no other function of this package."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if left.empty or right.empty:
            return pd.DataFrame({"q": left["q"][:0], "neighbour": right["t"][:0], "label": right["y"][:0], "distance": right["y"][:0]})
        right = right.sort_values("t", ignore_index=True)
        tv = np.stack(right["v"].to_numpy()).astype("float64")
        # one product gives the squared distances: -2 * v * q, and the two squared lengths
        sides = np.concatenate([-2.0 * tv, (tv**2).sum(1)[:, None], np.ones((len(tv), 1))], axis=1).T.copy()
        take, groups = min(k, len(tv)), len(tv) // GROUP
        asked, found, far = [], [], []
        # a slice of queries at a time keeps the distance matrix within the cache
        for at in range(0, len(left), SLICE):
            some = left.iloc[at : at + SLICE]
            qv = np.stack(some["v"].to_numpy()).astype("float64")
            length = (qv**2).sum(1)
            near = np.concatenate([qv, np.ones((len(qv), 1)), length[:, None]], axis=1) @ sides
            if groups > 4 * take:
                # the k-th of the least of groups of columns is no less than the k-th of all
                least = np.fmin.reduce(near[:, : groups * GROUP].reshape(len(qv), GROUP, groups), axis=1)
                kth = np.partition(least, take - 1, axis=1)[:, take - 1]
                few = np.isnan(kth)
                if few.any():
                    kth[few] = np.partition(near[few], take - 1, axis=1)[:, take - 1]
            else:
                kth = np.partition(near, take - 1, axis=1)[:, take - 1]
            # candidates within rounding of it, then exact distances
            within = near <= (kth + 1e-9 * (1.0 + np.abs(kth)) + 1e-12 * length)[:, None]
            i, cand = np.divmod(np.flatnonzero(within), len(tv))
            exact = np.sqrt(((tv[cand] - qv[i]) ** 2).sum(1))
            # rows are sorted by their key, so equal distances keep the lower one
            order = np.lexsort((cand, exact, i))
            i, cand, exact = i[order], cand[order], exact[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            kept = place < take
            asked.append(some["q"].to_numpy()[i[kept]])
            found.append(cand[kept])
            far.append(exact[kept])
        found = np.concatenate(found)
        return pd.DataFrame(
            {"q": np.concatenate(asked), "neighbour": right["t"].to_numpy()[found], "label": right["y"].to_numpy()[found], "distance": np.concatenate(far)}
        )

    return best


def nearest_neighbours(
    queries: DataFrame, train: DataFrame, k: int = 5, key: str = "vec_id", vec: str = "embedding", label: str = "label",
    block_rows: int = 20_000, train_blocks: int | None = None, query_blocks: int | None = None,
) -> DataFrame:
    """The ``k`` nearest training rows of every query: ``key, neighbour, label, distance``.

    Both sides are cut into blocks by a hash of their key.  A task meets one
    query block and one training block, multiplies them as matrices and keeps
    ``k`` rows per query, so pairs of rows are never materialised.  The number of
    blocks follows from ``block_rows``: with more rows there are more blocks, not
    larger ones.  Ties go to the lower key.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    train_blocks = train_blocks or max(1, -(-train.count() // block_rows))
    if query_blocks is None:
        # every query block meets all training rows, so few queries make few blocks
        n = queries.count()
        query_blocks = max(1, -(-n // block_rows), min(cores, -(-n // 256)))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def all_blocks(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    q = queries.select(F.col(key).alias("q"), F.col(vec).alias("v"), block(query_blocks).alias("qb")).select(
        "q", "v", "qb", all_blocks(train_blocks).alias("tb")
    )
    t = train.select(
        F.col(key).alias("t"), F.col(vec).alias("v"), F.col(label).cast("double").alias("y"), block(train_blocks).alias("tb")
    ).select("t", "v", "y", "tb", all_blocks(query_blocks).alias("qb"))

    partial = q.groupBy("qb", "tb").cogroup(t.groupBy("qb", "tb")).applyInPandas(
        block_search(k), f"q {dict(queries.dtypes)[key]}, neighbour {dict(train.dtypes)[key]}, label double, distance double"
    )
    w = Window.partitionBy("q").orderBy("distance", "neighbour")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("q", key)


def knn_regress(queries: DataFrame, train: DataFrame, k: int = 5, key: str = "vec_id", **options) -> DataFrame:
    """Mean label of the ``k`` nearest training rows."""
    return nearest_neighbours(queries, train, k, key, **options).groupBy(key).agg(F.avg("label").alias("prediction"))


def voting_average(predictions: Sequence[DataFrame], key: str, pred: str = "prediction") -> DataFrame:
    """Mean of several models' predictions on their common keys."""
    out = predictions[0].select(key, F.col(pred).alias("_p0"))
    for i, p in enumerate(predictions[1:], 1):
        out = out.join(p.select(key, F.col(pred).alias(f"_p{i}")), key)
    total = sum((F.col(f"_p{i}") for i in range(1, len(predictions))), F.col("_p0"))
    return out.select(key, (total / len(predictions)).alias(pred))


# -- random search ----------------------------------------------------------

def sample_grid(grid: Mapping[str, Sequence[Any]], n_iter: int, seed: int) -> list[dict[str, Any]]:
    """A random subset of a parameter grid, without building the whole grid."""
    names = sorted(grid)
    total = 1
    for n in names:
        total *= len(grid[n])
    picks = random.Random(seed).sample(range(total), min(n_iter, total))
    out = []
    for p in picks:
        point = {}
        for n in names:
            p, i = divmod(p, len(grid[n]))
            point[n] = grid[n][i]
        out.append(point)
    return out


def random_search(
    df: DataFrame, estimator: Estimator, grid: Mapping[str, Sequence[Any]], n_iter: int = 10, folds: int = 3,
    seed: int = 314, label: str = "label", parallelism: int = 4,
) -> CrossValidatorModel:
    """Cross-validated AUC over sampled points; the best point is refitted on all rows."""
    points = [
        {estimator.getParam(n): v for n, v in p.items()} for p in sample_grid(grid, n_iter, seed)
    ]
    return CrossValidator(
        estimator=estimator,
        estimatorParamMaps=points,
        evaluator=BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC"),
        numFolds=folds,
        seed=seed,
        parallelism=parallelism,
    ).fit(df)


def search_results(model: CrossValidatorModel, spark) -> DataFrame:
    """``trial, params, auc`` of a search: one row per sampled point."""
    rows = [
        (i, str(sorted((p.name, v) for p, v in pm.items())), float(auc))
        for i, (pm, auc) in enumerate(zip(model.getEstimatorParamMaps(), model.avgMetrics))
    ]
    return spark.createDataFrame(rows, "trial int, params string, auc double")
