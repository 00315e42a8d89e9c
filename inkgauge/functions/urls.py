"""Endpoint urls, metric names and histogram specifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import as_col


def normalize_url(endpoint: Column | str, version: Column | str) -> Column:
    """``endpoint/version`` without trailing slashes; a missing version is dropped."""
    base = F.rtrim(as_col(endpoint), F.lit("/"))
    return F.rtrim(F.concat(base, F.lit("/"), F.coalesce(as_col(version).cast("string"), F.lit(""))), F.lit("/"))


def metric_name(url: Column | str, variable: Column | str) -> Column:
    """``url:variable`` with other characters as ``_`` (parentheses survive)."""
    return F.regexp_replace(F.concat_ws(":", as_col(url), as_col(variable)), F.lit(r"[^(a-zA-Z0-9_:)]"), F.lit("_"))


def parse_bucket_spec(spec: Column | str) -> Column:
    """``x=0,1,2`` or ``x=min/max/step`` -> ``struct(name, buckets)``.

    Steps run from min up to, not including, max.  A malformed number is null.
    """
    spec = as_col(spec)
    name = F.substring_index(spec, "=", 1)
    body = F.regexp_replace(spec, F.lit(r"^[^=]*="), F.lit(""))
    part = F.split(body, "/")
    lo, hi, step = (F.trim(F.get(part, F.lit(i))).try_cast("double") for i in range(3))
    count = F.greatest(F.ceil(F.try_divide(hi - lo, step)), F.lit(0)).cast("int")
    stepped = F.when(
        count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: lo + i * step)
    ).otherwise(F.array().cast("array<double>"))
    listed = F.transform(F.split(body, ","), lambda b: F.trim(b).try_cast("double"))
    return F.struct(name.alias("name"), F.when(body.contains("/"), stepped).otherwise(listed).alias("buckets"))


def parse_enum_spec(spec: Column | str) -> Column:
    """``x=cat,dog`` -> ``struct(name, buckets)`` of trimmed strings."""
    spec = as_col(spec)
    body = F.regexp_replace(spec, F.lit(r"^[^=]*="), F.lit(""))
    return F.struct(
        F.substring_index(spec, "=", 1).alias("name"),
        F.transform(F.split(body, ","), lambda b: F.trim(b)).alias("buckets"),
    )


def round4(c: Column | str) -> Column:
    """Latency to a tenth of a millisecond."""
    return F.round(as_col(c), 4)


def json_encode(*cols: Column | str) -> Column:
    return F.to_json(F.struct(*cols))


def json_decode(c: Column | str, schema: str) -> Column:
    return F.from_json(as_col(c), schema)


def config_fingerprint(columns: list[str]) -> Column:
    """Stable hash of a configuration row; column order does not matter."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
