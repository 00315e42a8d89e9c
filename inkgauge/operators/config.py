"""Endpoint, canary and metric configuration tables: checks, merges, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import METRIC_TYPES, RESERVED_METRICS
from ..functions.prefixes import first_match
from ..functions.urls import config_fingerprint
from ..session import lookup_table, small_rows

TENSOR_FIELDS = ("input_type", "input_size", "input_name", "output_type", "output_size", "output_name")


def _blank(c: str) -> Column:
    """Null, empty text or empty array."""
    text = F.col(c).cast("string")
    return F.col(c).isNull() | text.isin("", "[]")


def violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """``key, reason`` for every check a row breaks, in one pass."""
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(r)) for r, cond in checks.items()]))
    return df.select(key, F.explode(reasons).alias("reason"))


def validate_endpoints(df: DataFrame, key: str = "serving_url") -> DataFrame:
    """Endpoints of the tensor engine need all tensor fields."""
    tensor = F.col("engine_type") == "triton"
    return violations(df, key, {f"missing {f}": tensor & _blank(f) for f in TENSOR_FIELDS})


def validate_monitoring(df: DataFrame, key: str = "base_serving_url") -> DataFrame:
    return violations(
        df, key, {"nothing to monitor": _blank("monitor_project") & _blank("monitor_name") & _blank("monitor_tags")}
    )


def validate_canary(df: DataFrame, key: str = "endpoint") -> DataFrame:
    """Prefix and list are exclusive; a list needs one weight per target."""
    listed = ~_blank("load_endpoints")
    return violations(
        df,
        key,
        {
            "prefix and list both set": listed & ~_blank("load_endpoint_prefix"),
            "weights do not match targets": listed
            & _blank("load_endpoint_prefix")
            & (F.size("weights") != F.size("load_endpoints")),
        },
    )


def validate_metrics(df: DataFrame, key: str = "endpoint", kind: str = "type") -> DataFrame:
    known = F.coalesce(F.col(kind).isin(*METRIC_TYPES), F.lit(False))
    return violations(df, key, {"unknown metric type": ~known})


def config_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``key, change`` with change in added, removed, changed (equal rows drop out)."""
    cols = [c for c in new.columns if c != key]
    a = old.select(key, config_fingerprint(cols).alias("_a"))
    b = new.select(key, config_fingerprint(cols).alias("_b"))
    change = (
        F.when(F.col("_a").isNull(), "added")
        .when(F.col("_b").isNull(), "removed")
        .when(F.col("_a") != F.col("_b"), "changed")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def unchanged(old: DataFrame, new: DataFrame, key: str) -> bool:
    """Whether two configuration tables agree, so that a sync has nothing to do."""
    return config_changes(old, new, key).isEmpty()


def merge_metric_config(old: DataFrame, new: DataFrame, update: bool, key: str = "endpoint", metrics: str = "metrics") -> DataFrame:
    """Metric maps per endpoint: merged when ``update``, else the new map replaces the old."""
    a = old.select(key, F.col(metrics).alias("_old"))
    b = new.select(key, F.col(metrics).alias("_new"))
    kept = F.map_filter("_old", lambda k, _v: ~F.array_contains(F.map_keys("_new"), k))
    both = F.map_concat(kept, F.col("_new")) if update else F.col("_new")
    merged = F.when(F.col("_new").isNull(), F.col("_old")).when(F.col("_old").isNull(), F.col("_new")).otherwise(both)
    return a.join(b, key, "full_outer").select(key, merged.alias(metrics))


def remove_metric(df: DataFrame, endpoint: str, variable: str | None = None, key: str = "endpoint", metrics: str = "metrics") -> DataFrame:
    """Remove one variable of an endpoint, or the whole endpoint."""
    name = endpoint.strip("/")
    if variable is None:
        return df.where(F.col(key) != name)
    fewer = F.map_filter(metrics, lambda k, _v: k != variable)
    return df.withColumn(metrics, F.when(F.col(key) == name, fewer).otherwise(F.col(metrics)))


# -- joins with configuration -----------------------------------------------

def first_of(cfg: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key: the smallest by the other columns in their order, so a repeated key never multiplies rows."""
    rest = [c for c in cfg.columns if c not in keys]
    if not rest:
        return cfg.distinct()
    best = cfg.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_first"))
    return best.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*cfg.columns)


def lookup_metric_config(stats: DataFrame, cfg: DataFrame) -> DataFrame:
    """Statistics rows ``(url, variable, ...)`` with their metric type and bounds.

    Reserved variables are logged for every url; other variables only where
    ``cfg(url, variable, type, buckets)`` names them.  Of several rows for one
    url and variable the smallest by the other columns counts.
    """
    joined = stats.join(lookup_table(first_of(cfg, ["url", "variable"])), ["url", "variable"], "left")
    reserved = F.col("variable").isin(*RESERVED_METRICS)
    kind = (
        F.when(F.col("variable") == "_latency", "scalar").when(F.col("variable") == "_count", "counter").otherwise(F.col("type"))
    )
    return joined.withColumn("type", kind).where(reserved | F.col("type").isNotNull())


def match_prefix_config(endpoints: DataFrame, cfg: DataFrame, url: str = "url") -> DataFrame:
    """The configuration of each endpoint: exact name first, else the first wildcard.

    ``cfg(name, ord, ...)``: a name ending in ``*`` matches every url that starts
    with the rest (the documented meaning); of rows that match alike the smallest by
    ``ord`` and the other columns counts.  Names within the bounds of ``small_rows``
    are one tree of characters that each url walks down once, more of them a hash
    join on the prefixes of the lengths that occur.  Urls without a match drop out.
    """
    rest = [c for c in cfg.columns if c not in ("name", "ord")]
    wild = F.col("name").endswith("*")
    key = F.when(wild, F.expr("left(name, length(name) - 1)")).otherwise(F.col("name"))
    best = cfg.where("name is not null").groupBy(wild.cast("int").alias("_kind"), key.alias("_key")).agg(F.min(F.struct("ord", "name", *rest)).alias("_cfg"))
    table = lookup_table(best)
    names = lookup_table(table.select("_kind", "_key", "_cfg.ord"))
    rows = small_rows(names)
    urls = endpoints.select(url).where(F.col(url).isNotNull()).distinct()
    if rows is not None:
        number = {(r["_kind"], r["_key"]): i for i, r in enumerate(sorted(rows, key=lambda r: (r["ord"] is not None, r["ord"], r["_key"])))}
        exact, prefixes = ({k: i for (kind, k), i in number.items() if kind == wanted} for wanted in (0, 1))
        found = urls.withColumn("_nr", first_match(F.col(url), exact, prefixes)).where("_nr is not null")
        numbered = endpoints.sparkSession.createDataFrame([(*k, i) for k, i in number.items()], "_kind int, _key string, _nr bigint")
        hits = found.join(table.join(numbered, ["_kind", "_key"]), "_nr")
        return hits.select(url, *[F.col(f"_cfg.{f}").alias(f) for f in ("name", *rest)])
    lengths = sorted(r[0] for r in names.where("_kind = 1").select(F.length("_key")).distinct().collect())
    u = F.col(url)
    cut = [F.when(F.length(u) >= n, F.struct(F.lit(1).alias("_kind"), F.left(u, F.lit(n)).alias("_key"))) for n in lengths]
    options = urls.select(url, F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("_kind"), u.alias("_key")), *cut))).alias("o"))
    hits = options.select(url, "o.*").join(table, ["_kind", "_key"])
    first = hits.groupBy(url).agg(F.min_by("_cfg", F.struct("_kind", "_cfg.ord", "_key")).alias("c"))
    return first.select(url, *[F.col(f"c.{f}").alias(f) for f in ("name", *rest)])


def resolve_endpoint(requests: DataFrame, static: DataFrame, monitored: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``model_id`` and ``found_in``; static endpoints win over monitored ones.

    A request without an endpoint keeps nulls: ``unresolved`` selects those.  Of
    several models for one url the smallest id counts.
    """
    s = lookup_table(first_of(static.select(F.col(url), F.col("model_id").alias("_s")), [url]))
    m = lookup_table(first_of(monitored.select(F.col(url), F.col("model_id").alias("_m")), [url]))
    return (
        requests.join(s, url, "left")
        .join(m, url, "left")
        .withColumn("model_id", F.coalesce("_s", "_m"))
        .withColumn("found_in", F.when(F.col("_s").isNotNull(), "static").when(F.col("_m").isNotNull(), "monitored"))
        .drop("_s", "_m")
    )


def unresolved(requests: DataFrame, static: DataFrame, monitored: DataFrame, url: str = "url") -> DataFrame:
    known = lookup_table(static.select(url).unionByName(monitored.select(url)).distinct())
    return requests.join(known, url, "left_anti")


def auto_registered(stats: DataFrame, configured: DataFrame, url: str = "url") -> DataFrame:
    """Urls seen in the statistics that no configuration names."""
    return stats.select(url).distinct().join(configured.select(url).distinct(), url, "left_anti")
