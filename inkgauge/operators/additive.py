"""Additive boosting: an interpretable model of binned shape functions.

``g(E[y]) = intercept + sum of f_i(bin of x_i) + sum of f_ij(bins of x_i, x_j)``

The binned table is written once.  A round is one scan that sums gradients and
hessians per term and bin (``boosting``), for one model or for all points and
folds of a search; the models are small tables on the driver.  No score column is
carried from round to round, so the plan does not grow.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import boosting as BO
from ..functions.base import draw
from ..session import written
from .frame import best_trial
from .models import sample_grid

MODEL_SCHEMA = "term string, bin int, score double"


@dataclass
class AdditiveModel:
    features: list[str]
    bounds: dict[str, list[float]]
    intercept: float
    pairs: list[tuple[str, str]] = field(default_factory=list)
    scores: dict[str, list[float]] = field(default_factory=dict)

    def terms(self) -> list[str]:
        return [*self.features, *[pair_name(a, b) for a, b in self.pairs]]

    def bin_count(self, term: str) -> int:
        """Bins of a term; the last one of a feature holds its missing values."""
        if term in self.bounds:
            return len(self.bounds[term]) + 2
        a, b = next(p for p in self.pairs if pair_name(*p) == term)
        return self.bin_count(a) * self.bin_count(b)

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, i, float(s)) for t in self.terms() for i, s in enumerate(self.scores[t])]
        return spark.createDataFrame([("intercept", 0, float(self.intercept)), *rows], MODEL_SCHEMA)


def pair_name(a: str, b: str) -> str:
    return f"{a} & {b}"


def bin_of(value: Column, bounds: Sequence[float]) -> Column:
    """How many bounds lie below the value: bin 0 up to ``len(bounds)``; one more for null and NaN."""
    out = F.when(value.isNull() | F.isnan(value), F.lit(len(bounds) + 1))
    for i, b in enumerate(bounds):
        out = out.when(value <= F.lit(float(b)), F.lit(i))
    return out.otherwise(F.lit(len(bounds)))


def quantile_bounds(df: DataFrame, features: Sequence[str], bins: int, accuracy: int = 10_000) -> dict[str, list[float]]:
    """Inner quantiles per feature from one pass; repeats and the maximum are left out."""
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])

    def known(f: str) -> Column:
        return F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))

    row = df.agg(
        *[F.percentile_approx(known(f), probs, accuracy).alias(f"q{i}") for i, f in enumerate(features)],
        *[F.max(known(f)).alias(f"m{i}") for i, f in enumerate(features)],
    ).first()
    return {f: sorted({b for b in row[f"q{i}"] or [] if row[f"m{i}"] is not None and b < row[f"m{i}"]}) for i, f in enumerate(features)}


def _binned(df: DataFrame, model: AdditiveModel) -> DataFrame:
    """Adds one ``b_<term>`` column per term."""
    out = df
    for f in model.features:
        out = out.withColumn(f"b_{f}", bin_of(F.col(f).cast("double"), model.bounds[f]))
    for a, b in model.pairs:
        out = out.withColumn(f"b_{pair_name(a, b)}", F.col(f"b_{a}") * model.bin_count(b) + F.col(f"b_{b}"))
    return out


def _term_score(model: AdditiveModel, term: str) -> Column:
    table = F.array(*[F.lit(float(s)) for s in model.scores[term]])
    return F.get(table, F.col(f"`b_{term}`"))


def _raw_score(model: AdditiveModel) -> Column:
    out = F.lit(float(model.intercept))
    for t in model.terms():
        out = out + _term_score(model, t)
    return out


def fit_additive_boosting(
    df: DataFrame, features: Sequence[str], label: str = "label", bins: int = 16, rounds: int = 20, lr: float = 0.3,
    pairs: Sequence[tuple[str, str]] = (), cyclic: bool = False, min_hessian: float = 1e-6, max_leaves: int | None = None,
    min_samples_leaf: int = 1, interactions: int = 0, patience: int | None = None, tolerance: float = 1e-4,
    validation: float = 0.15, key: str = "doc_id", seed: int = 42,
) -> AdditiveModel:
    """Logistic additive boosting.

    By default a round updates all terms from one scan, each with ``lr`` shared
    among them; ``cyclic`` updates one term per scan in turn, with the full
    ``lr``.  With ``max_leaves`` a step is a tree on the bins of a term, cut best
    first, and otherwise every bin is a leaf; a leaf has at least
    ``min_samples_leaf`` rows.  ``interactions`` adds so many pairs, chosen by what
    the single terms leave, in as many rounds again.  With ``patience`` a seeded draw
    of ``key`` holds out the share ``validation``, and boosting ends when the loss on it has
    not fallen by ``tolerance`` for so many rounds.
    """
    features = list(features)
    fold = F.when(draw(key, seed) < validation, 1).otherwise(0) if patience is not None else F.lit(0)
    table = binned_table(df, features, label, bins, fold.cast("int"))
    options = {
        "rounds": rounds, "lr": lr, "cyclic": cyclic, "min_hessian": min_hessian, "max_leaves": max_leaves,
        "min_samples_leaf": min_samples_leaf, "patience": patience, "tolerance": tolerance, "hold": 1 if patience is not None else None,
    }
    fit = table.fit([(features.index(a), features.index(b)) for a, b in pairs], **options)
    BO.advance(table.rows, [fit], len(features))
    if interactions:
        found = BO.strongest_pairs(table.rows, fit, len(features), interactions)
        more = [p for p in found if p not in fit.terms]
        if more:
            fit = table.with_pairs(fit, more, **options)
            BO.advance(table.rows, [fit], len(features))
    return table.model(fit)


@dataclass
class Binned:
    """A written table ``y, fold, b0, b1, ...`` with the bounds of its bins and its counts by fold."""

    rows: DataFrame
    features: list[str]
    bounds: dict[str, list[float]]
    counts: dict[int, tuple[float, int]]

    def fit(self, pairs: Sequence[tuple[int, int]] = (), hold: int | None = None, **options: Any) -> BO.Fit:
        """A model to be trained on all rows but those of the fold ``hold``."""
        known = [v for k, v in self.counts.items() if k != hold]
        p, n = sum(v[0] for v in known), sum(v[1] for v in known)
        if not n or p in (0.0, float(n)):
            raise ValueError("both classes are needed")
        terms = [*[(i,) for i in range(len(self.features))], *pairs]
        sizes = [len(self.bounds[f]) + 2 for f in self.features]
        return BO.Fit(terms, sizes, math.log(p / (n - p)), hold=hold, **options)

    def with_pairs(self, fit: BO.Fit, pairs: Sequence[tuple[int, int]], hold: int | None = None, **options: Any) -> BO.Fit:
        """A model that goes on from another one's scores with more pairs."""
        out = self.fit([*fit.terms[len(self.features) :], *pairs], hold=hold, **options)
        out.scores[: len(fit.scores)] = fit.scores
        return out

    def model(self, fit: BO.Fit) -> AdditiveModel:
        pairs = [(self.features[a], self.features[b]) for a, b in fit.terms[len(self.features) :]]
        model = AdditiveModel(self.features, self.bounds, fit.intercept, pairs)
        model.scores = {t: [float(x) for x in s] for t, s in zip(model.terms(), fit.scores)}
        return model


def binned_table(df: DataFrame, features: list[str], label: str, bins: int, fold: Column) -> Binned:
    bounds = quantile_bounds(df, features, bins)
    columns = [bin_of(F.col(f"`{f}`").cast("double"), bounds[f]).cast("int").alias(f"b{i}") for i, f in enumerate(features)]
    known = df.where(F.col(label).isNotNull())
    rows = written(known.select(F.col(label).cast("double").alias("y"), fold.alias("fold"), *columns), "bins")
    counts = {r["fold"]: (r["p"], r["n"]) for r in rows.groupBy("fold").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()}
    return Binned(rows, features, bounds, counts)


#: Names of the parameters of other libraries of such models.
OTHER_NAMES = {"learning_rate": "lr", "max_rounds": "rounds", "max_bins": "bins", "early_stopping_rounds": "patience", "early_stopping_tolerance": "tolerance"}
SEARCHED = {"bins", "rounds", "lr", "pairs", "cyclic", "min_hessian", "max_leaves", "min_samples_leaf", "interactions", "patience", "tolerance"}


def _grid_point(point: Mapping[str, Any]) -> dict[str, Any]:
    """Keyword arguments of ``fit_additive_boosting``, checked by name."""
    own = {OTHER_NAMES.get(k, k): v for k, v in point.items()}
    if set(own) - SEARCHED:
        raise ValueError(f"unknown parameters {sorted(set(own) - SEARCHED)}")
    return own


def search_additive(
    df: DataFrame, features: Sequence[str], grid: Mapping[str, Sequence[Any]], n_iter: int = 10, folds: int = 3,
    seed: int = 314, label: str = "label", key: str = "doc_id", halving: int = 0,
) -> tuple[AdditiveModel, DataFrame]:
    """Random search by cross-validated AUC; the best point is refitted on all rows.

    Folds follow a seeded draw of the key, so a row keeps its fold in every task
    and run.  All points of one number of bins advance together through all folds:
    jobs grow with the rounds, not with the points.  With ``halving`` the weaker half
    of the points still running, by their loss on the folds held out, ends after each of
    so many equal shares of the rounds; they are reported as they then are.  Returns the
    refitted model and ``trial, params, auc, rounds``; ``auc`` is the mean over folds.
    """
    spark, features = df.sparkSession, list(features)
    fold = F.floor(draw(key, seed) * folds).cast("int")
    points = [_grid_point(p) for p in sample_grid(grid, n_iter, seed)]
    results: dict[int, tuple[float, int]] = {}
    for bins in sorted({p.get("bins", 16) for p in points}):
        table = binned_table(df, features, label, bins, fold)
        mine = [i for i, p in enumerate(points) if p.get("bins", 16) == bins]
        fits = {(i, k): _point_fit(table, points[i], k) for i in mine for k in range(folds)}
        _run_points(table, fits, halving)
        paired = {}
        for (i, k), fit in fits.items():
            if points[i].get("interactions") and fit.running:
                more = [p for p in BO.strongest_pairs(table.rows, fit, len(features), points[i]["interactions"]) if p not in fit.terms]
                if more:
                    paired[i, k] = table.with_pairs(fit, more, hold=k, **_fit_options(points[i]))
        if paired:
            _run_points(table, paired, 0)
            fits.update(paired)
        aucs = held_out_auc(table.rows, fits, len(features))
        for i in mine:
            results[i] = (sum(aucs[i, k] for k in range(folds)) / folds, max(fits[i, k].done for k in range(folds)))
    rows = [(i, str(sorted(p.items())), *results[i]) for i, p in enumerate(points)]
    trials = spark.createDataFrame(rows, "trial int, params string, auc double, rounds int")
    best = points[best_trial(trials).first()["trial"]]
    return fit_additive_boosting(df, features, label, key=key, **best), trials


def _fit_options(point: Mapping[str, Any]) -> dict[str, Any]:
    return {k: v for k, v in point.items() if k not in ("bins", "pairs", "interactions")}


def _point_fit(table: Binned, point: Mapping[str, Any], hold: int) -> BO.Fit:
    pairs = [(table.features.index(a), table.features.index(b)) for a, b in point.get("pairs", ())]
    return table.fit(pairs, hold=hold, **_fit_options(point))


def _run_points(table: Binned, fits: dict[tuple[int, int], BO.Fit], halving: int) -> None:
    every = list(fits.values())
    longest = max(fit.scans() for fit in every)
    for share in range(1, halving + 1):
        BO.advance(table.rows, every, len(table.features), max(1, longest * share // (halving + 1)))
        alive = sorted({i for (i, _), fit in fits.items() if fit.running})
        loss = {i: sum(fit.losses[-1] for (j, _), fit in fits.items() if j == i and fit.losses) for i in alive}
        for i in sorted(alive, key=lambda i: (loss[i], i))[(len(alive) + 1) // 2 :]:
            for (j, _), fit in fits.items():
                fit.running = fit.running and j != i
    BO.advance(table.rows, every, len(table.features))


#: Equal steps of the score in which negatives are first counted.
SCORE_STEPS = 4096


def held_out_auc(rows: DataFrame, fits: dict[tuple[int, int], BO.Fit], features: int) -> dict[tuple[int, int], float]:
    """The exact AUC of every model on the rows of its fold, all from one scan.

    Equal scores are counted together; a pair of them counts half.
    """
    named = list(fits)

    def score_batches(batches):
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            columns = BO.columns_of(batch, features)
            for number, name in enumerate(named):
                out = fold == name[1]
                if out.any():
                    raw = fits[name].raw([c[out] for c in columns], int(out.sum()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), number, np.int32)), pa.array(np.round(raw, 12)), pa.array(y[out])], names=["fit", "raw", "y"])

    scored = rows.mapInArrow(score_batches, "fit int, raw double, y double")
    counts = scored.groupBy("fit", "raw").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    step = F.floor(SCORE_STEPS / (1 + F.exp(-F.col("raw"))))
    counts = written(counts.withColumn("step", step), "scores")
    steps = counts.groupBy("fit", "step").agg(F.sum("neg").alias("neg"))
    before = Window.partitionBy("fit").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("fit", "step", F.coalesce(F.sum("neg").over(before), F.lit(0.0)).alias("below"))
    within = Window.partitionBy("fit", "step").orderBy("raw").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("under", F.coalesce(F.sum("neg").over(within), F.lit(0.0))).join(steps, ["fit", "step"])
    won = F.sum(F.col("pos") * (F.col("below") + F.col("under") + F.col("neg") / 2))
    found = ranked.groupBy("fit").agg(won.alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()
    return {named[r["fit"]]: r["won"] / (r["pos"] * r["neg"]) if r["pos"] and r["neg"] else float("nan") for r in found}


def predict_additive(df: DataFrame, model: AdditiveModel) -> DataFrame:
    """Adds ``raw`` and ``score`` (probability of class 1)."""
    binned = _binned(df, model)
    raw = binned.withColumn("raw", _raw_score(model)).drop(*[f"b_{t}" for t in model.terms()])
    return raw.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("raw"))))


def explain_additive(df: DataFrame, model: AdditiveModel, key: str) -> DataFrame:
    """``key, term, contribution``: what each term adds to a row's raw score."""
    parts = F.array(
        *[F.struct(F.lit(t).alias("term"), _term_score(model, t).alias("contribution")) for t in model.terms()]
    )
    return _binned(df, model).select(key, F.inline(parts))


def term_importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per term."""
    return contributions.groupBy("term").agg(F.avg(F.abs("contribution")).alias("importance"))
