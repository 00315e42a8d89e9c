"""Request statistics: sampling, per-request rows, logged keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import as_col, draw
from ..functions.urls import round4
from ..operators.frame import select_logged_keys
from ..operators.histograms import scaled_count
from ..session import lookup_table


def sample_stream(df: DataFrame, freq: Column | str, key: str, seed: int) -> DataFrame:
    """Rows to log: frequency 0 keeps none, 1 and above all, else a seeded draw.

    A filter on the row itself: it works on streams and comes before any shuffle.
    """
    f = as_col(freq).cast("double")
    return df.where((f > 0) & ((f >= 1) | (draw(key, seed) <= f)))


def with_frequency(requests: DataFrame, cfg: DataFrame, default: float, url: str = "url") -> DataFrame:
    """Adds ``log_frequency``: the endpoint's own, else the global one."""
    own = lookup_table(cfg.select(F.col(url), F.col("log_frequency").cast("double").alias("_own")))
    return (
        requests.join(own, url, "left")
        .withColumn("log_frequency", F.coalesce("_own", F.lit(float(default))))
        .drop("_own")
    )


def request_stats(
    requests: DataFrame, url: str = "url", latency: str = "latency", freq: Column | str | None = None,
    request: str | None = None, response: str | None = None, metric_keys: Column | None = None,
    custom: str | None = None,
) -> DataFrame:
    """Adds ``stats``: the map one sampled request reports.

    ``_latency`` (4 decimals), ``_count`` (requests it stands for) and ``_url``,
    then custom statistics, then the configured keys of request and response.
    Works on static and streaming frames.
    """
    f = as_col(freq) if freq is not None else F.lit(1.0)
    base = F.create_map(
        F.lit("_latency"), round4(latency).cast("string"),
        F.lit("_count"), scaled_count(f).cast("string"),
        F.lit("_url"), F.col(url),
    )
    empty = F.create_map().cast("map<string,string>")
    parts = empty
    if custom is not None:
        parts = F.coalesce(F.col(custom), empty)
    if metric_keys is not None:
        req = F.coalesce(F.col(request), empty) if request else empty
        res = F.coalesce(F.col(response), empty) if response else empty
        logged = select_logged_keys(req, res, metric_keys)
        kept = F.map_filter(parts, lambda k, _v: ~F.array_contains(F.map_keys(logged), k))
        parts = F.map_concat(kept, logged)
    kept_base = F.map_filter(base, lambda k, _v: ~F.array_contains(F.map_keys(parts), k))
    return requests.withColumn("stats", F.map_concat(kept_base, parts))
