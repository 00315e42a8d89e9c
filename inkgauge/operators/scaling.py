"""Column scalers fitted in one pass and kept as tables ``(col, min, max, mean, std)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALER_SCHEMA = "col string, min double, max double, mean double, std double"


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, maximum, mean and population std of each column, in one pass.

    Null, NaN and infinite values do not count; a column without any other value has nulls.
    """
    columns = list(columns)

    def known(c: str) -> Column:
        value = F.col(c).cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)

    one = df.agg(
        *[
            F.struct(
                F.lit(c).alias("col"),
                F.min(known(c)).alias("min"),
                F.max(known(c)).alias("max"),
                F.avg(known(c)).alias("mean"),
                F.stddev_pop(known(c)).alias("std"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    )
    return one.select(F.inline(F.array(*[f"s{i}" for i in range(len(columns))])))


def _stats(scaler: DataFrame) -> dict[str, dict[str, float]]:
    """The scaler on the driver: one row per scaled column."""
    return {r["col"]: r.asDict() for r in scaler.collect()}


def _apply(df: DataFrame, scaled: Mapping[str, Column]) -> DataFrame:
    """``<col>_scaled`` columns replace the originals."""
    keep = [c for c in df.columns if c not in scaled]
    return df.select(*keep, *[c.alias(f"{n}_scaled") for n, c in scaled.items()])


def _flat(value: Column) -> Column:
    """0 for every finite value; others stay what they are."""
    return F.when(F.abs(value) == F.lit(float("inf")), value).otherwise(value * 0.0)


def minmax_transform(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min-max scaling; a constant column becomes 0, NaN, null and infinite values stay what they are."""
    stats = _stats(scaler)

    def scale(c: str) -> Column:
        lo, hi = stats[c]["min"], stats[c]["max"]
        if lo is None or hi == lo:
            return _flat(F.col(c).cast("double"))
        return (F.col(c).cast("double") - F.lit(lo)) / F.lit(hi - lo)

    return _apply(df, {c: scale(c) for c in columns})


def standard_transform(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean, unit population std; a constant column becomes 0, NaN, null and infinite values stay what they are."""
    stats = _stats(scaler)

    def scale(c: str) -> Column:
        mean, std = stats[c]["mean"], stats[c]["std"]
        if not std:
            return _flat(F.col(c).cast("double"))
        return (F.col(c).cast("double") - F.lit(mean)) / F.lit(std)

    return _apply(df, {c: scale(c) for c in columns})


def scale_feature_groups(
    df: DataFrame, groups: Mapping[str, Sequence[str]], scalers: Mapping[str, DataFrame] | None = None
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Min-max scaling of several column groups, each with its own scaler table.

    Given scalers are applied as they are; missing ones are fitted together in
    one pass and split by group.
    """
    scalers = dict(scalers or {})
    todo = {g: list(c) for g, c in groups.items() if g not in scalers}
    if todo:
        fitted = fit_scaler(df, list(dict.fromkeys(c for cols in todo.values() for c in cols))).collect()
        for g, cols in todo.items():
            rows = [tuple(r) for r in fitted if r["col"] in set(cols)]
            scalers[g] = df.sparkSession.createDataFrame(rows, SCALER_SCHEMA)
    out = df
    for g, cols in groups.items():
        out = minmax_transform(out, scalers[g], list(cols))
    return out, scalers


def save_scaler(scaler: DataFrame, path: str) -> None:
    scaler.write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCALER_SCHEMA).parquet(path)
