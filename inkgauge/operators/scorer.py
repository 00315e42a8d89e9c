"""Pluggable batch scoring: load once per task, then preprocess, process, postprocess."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import argmax, dot, positive_score


# Scorers travel to the workers with their code, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Scorer:
    """The user contract; override what is needed.

    ``preprocess`` may add columns that ``postprocess`` reads: they are the
    per-request state.  A ``stats`` map column carries custom statistics.
    """

    def load(self, path: str | None) -> Any:
        return None

    def preprocess(self, batch: pd.DataFrame) -> pd.DataFrame:
        return batch

    def process(self, batch: pd.DataFrame, model: Any) -> pd.DataFrame:
        return batch

    def postprocess(self, batch: pd.DataFrame) -> pd.DataFrame:
        return batch


def batch_score(df: DataFrame, scorer: Scorer, schema: T.StructType | str, path: str | None = None) -> DataFrame:
    """Run a scorer over Arrow batches; the model is loaded once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer.load(path)
        for batch in batches:
            yield scorer.postprocess(scorer.process(scorer.preprocess(batch), model))

    return df.mapInPandas(run, schema)


def linear_scorer(vector: str, weights: Sequence[float], bias: float = 0.0) -> Scorer:
    """A linear model over an array column: adds ``score`` and ``prediction``."""

    class Linear(Scorer):
        def process(self, batch, model):
            import numpy as np

            w = np.asarray(weights, dtype="float64")
            if len(batch):
                scores = np.stack(batch[vector].to_numpy()).astype("float64") @ w + bias
            else:
                scores = np.empty(0)
            return batch.assign(score=scores, prediction=(scores > 0).astype("int32"))

    return Linear()


def custom_scorer(fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Scorer:
    """A scorer from one function over a batch."""

    class Custom(Scorer):
        def process(self, batch, model):
            return fn(batch)

    return Custom()


# Engine name -> factory.  An asynchronous engine has no meaning of its own in a batch.
ENGINES: dict[str, Callable[..., Scorer]] = {
    "linear": linear_scorer,
    "custom": custom_scorer,
    "custom_async": custom_scorer,
}


def register_engine(name: str, factory: Callable[..., Scorer]) -> None:
    ENGINES[name] = factory


def engine(name: str, *args, **kwargs) -> Scorer:
    if name not in ENGINES:
        raise ValueError(f"unknown engine {name!r}")
    return ENGINES[name](*args, **kwargs)


def linear_score(vector: Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    """The linear model as a column expression: no Python worker."""
    return dot(vector, F.array(*[F.lit(float(w)) for w in weights])) + F.lit(float(bias))


def score_logits(df: DataFrame, logits: str) -> DataFrame:
    """Adds ``predicted_label`` and the class-1 ``probability`` of two-class logits."""
    return df.withColumn("predicted_label", argmax(logits)).withColumn("probability", positive_score(logits))


def text_function(fn: Callable[[pd.Series], pd.Series], returns: str = "double"):
    """A vectorised user function on a text column; built-ins are preferred."""
    return F.pandas_udf(fn, returns)


def ensemble_scores(
    a: DataFrame, b: DataFrame, key: str, weights: tuple[float, float] = (0.5, 0.5), score: str = "score"
) -> DataFrame:
    """Weighted sum of two score tables on their common keys."""
    left = a.select(key, F.col(score).alias("_a"))
    right = b.select(key, F.col(score).alias("_b"))
    return left.join(right, key).select(key, (F.lit(weights[0]) * F.col("_a") + F.lit(weights[1]) * F.col("_b")).alias(score))


def ensemble_errors(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys scored on one side only."""
    left = a.select(key, F.lit(True).alias("_a"))
    right = b.select(key, F.lit(True).alias("_b"))
    missing = F.when(F.col("_a").isNull(), "a").when(F.col("_b").isNull(), "b")
    return left.join(right, key, "full_outer").select(key, missing.alias("missing")).where("missing IS NOT NULL")
