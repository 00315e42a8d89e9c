"""Histograms, gauges and counters over statistics rows ``(url, variable, value)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import LATENCY_BOUNDS
from ..functions.base import as_col

INF = float("inf")


def first_bound(value: Column | str, bounds: Sequence[float]) -> Column:
    """The first literal bound that is not below the value, else +Inf (one CASE)."""
    v = as_col(value)
    out = None
    for b in bounds:
        out = F.when(v <= float(b), F.lit(float(b))) if out is None else out.when(v <= float(b), F.lit(float(b)))
    rest = F.when(v.isNotNull(), F.lit(INF))
    return rest if out is None else out.otherwise(rest)


def bound_label(value: Column | str, bounds: Sequence[float]) -> Column:
    """``first_bound`` as text: the labels are constants, no number is formatted per row."""
    v = as_col(value)
    out = None
    for b in map(float, bounds):
        label = F.lit(b).cast("string")
        out = F.when(v <= b, label) if out is None else out.when(v <= b, label)
    rest = F.when(v.isNotNull(), F.lit(INF).cast("string"))
    return rest if out is None else out.otherwise(rest)


def first_bound_of(value: Column, bounds: Column) -> Column:
    """The same for bounds that arrive as an array column."""
    hit = F.get(F.filter(bounds, lambda b: value <= b), F.lit(0))
    return F.coalesce(hit, F.when(value.isNotNull(), F.lit(INF)))


def bucket_counts(df: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """Observations per key and bucket, combined map-side."""
    return df.withColumn("bucket", bucket).where(F.col("bucket").isNotNull()).groupBy(*keys, "bucket").agg(
        F.count("*").alias("n")
    )


def scalar_histogram(
    df: DataFrame, bounds: Sequence[float], value: str = "value", keys: Sequence[str] = ("url",)
) -> DataFrame:
    """Non-cumulative histogram: ``keys, le, n, total``; empty buckets are kept.

    ``total`` counts observations, not their sum.  Values above the last bound
    are counted under +Inf.
    """
    counts = bucket_counts(df, keys, first_bound(value, bounds))
    wide = counts.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("bucket") == b, F.col("n")).otherwise(0)).alias(f"b{i}") for i, b in enumerate([*map(float, bounds), INF])],
        F.sum("n").alias("total"),
    )
    cells = F.array(
        *[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate([*map(float, bounds), INF])]
    )
    return wide.select(*keys, "total", F.inline(cells)).select(*keys, "le", "n", "total")


def latency_histogram(df: DataFrame, value: str = "latency", keys: Sequence[str] = ("url",)) -> DataFrame:
    return scalar_histogram(df, LATENCY_BOUNDS, value, keys)


def observations(df: DataFrame, values: str, out: str = "value") -> DataFrame:
    """One row per element where a statistic carries a list of values."""
    others = [c for c in df.columns if c != values]
    return df.select(*others, F.explode(values).alias(out))


def check_enum(enum: Sequence[str]) -> list[str]:
    names = [str(e) for e in enum]
    if names != sorted(names):
        raise ValueError("enum values must be sorted")
    if len(names) < 2:
        raise ValueError("an enum needs at least two values")
    return names


def enum_histogram(
    df: DataFrame, enum: Sequence[str], value: str = "value", keys: Sequence[str] = ("url",)
) -> DataFrame:
    """Counts per declared enum value: ``keys, enum, n, total, unknown``.

    An undeclared value counts in ``total`` and ``unknown`` and disturbs no
    other metric.
    """
    names = check_enum(enum)
    wide = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        *[F.count_if(F.col(value) == e).alias(f"e{i}") for i, e in enumerate(names)],
        F.count("*").alias("total"),
        F.count_if(~F.col(value).isin(*names)).alias("unknown"),
    )
    cells = F.array(*[F.struct(F.lit(e).alias("enum"), F.col(f"e{i}").alias("n")) for i, e in enumerate(names)])
    return wide.select(*keys, "total", "unknown", F.inline(cells)).select(*keys, "enum", "n", "total", "unknown")


def gauge_last(df: DataFrame, value: str = "value", keys: Sequence[str] = ("url",), order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Last value by arrival."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("value"))


def scaled_count(freq: Column | str) -> Column:
    """Requests one sampled request stands for: 0.4 -> 2, above 1 -> 0, 0 -> null."""
    f = as_col(freq).cast("double")
    return F.floor(F.try_divide(F.lit(1.0), f)).cast("bigint")


def counter_total(df: DataFrame, amount: Column | str, keys: Sequence[str] = ("url",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(as_col(amount)).alias("total"))


def bucket_share_over_time(
    df: DataFrame, bucket: Column, ts: str = "ts", keys: Sequence[str] = ("url",), width: str = "1 minute"
) -> DataFrame:
    """Percent of observations per bucket within tumbling windows.

    Events shrink to one row per window and bucket first; the window total is
    then taken over those few rows.
    """
    counts = (
        df.withColumn("bucket", bucket)
        .where(F.col("bucket").isNotNull())
        .groupBy(*keys, F.window(ts, width).alias("w"), "bucket")
        .agg(F.count("*").alias("n"))
    )
    totals = counts.groupBy(*keys, "w").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("bucket", "n")).alias("b")
    )
    return totals.select(*keys, F.col("w.start").alias("window_start"), "total", F.inline("b")).withColumn(
        "share", 100.0 * F.col("n") / F.col("total")
    )


def to_metric_samples(hist: DataFrame, label: str = "le", keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Tall samples ``metric, label, label_value, value``.

    Each bucket gives a ``_bucket`` row and repeats the total as ``_sum``.
    """
    metric = F.concat_ws(":", *keys)
    kinds = F.array(
        F.struct(F.concat(metric, F.lit("_bucket")).alias("metric"), F.col("n").cast("double").alias("value")),
        F.struct(F.concat(metric, F.lit("_sum")).alias("metric"), F.col("total").cast("double").alias("value")),
    )
    value = F.col(label)
    if dict(hist.dtypes)[label] == "double":
        value = F.when(value == INF, F.lit("+Inf")).otherwise(value.cast("string"))
    return hist.select(value.alias("label_value"), F.inline(kinds)).select(
        "metric", F.lit(label).alias("label"), "label_value", "value"
    )


# Metric type name -> how its values are folded; the table the streams read too.
AGGREGATES = {
    "scalar": scalar_histogram,
    "enum": enum_histogram,
    "value": gauge_last,
    "counter": counter_total,
}


def aggregate_metric(kind: str, df: DataFrame, **options) -> DataFrame:
    """Fold one variable by its configured metric type."""
    if kind not in AGGREGATES:
        raise ValueError(f"unknown metric type {kind!r}")
    return AGGREGATES[kind](df, **options)
