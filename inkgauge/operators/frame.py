"""Projections, filters, unions, distinct rows and small aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import DETAILED_PROMPT, REWRITE_PROMPT, STANDARD_PROMPT
from ..functions.base import as_col
from ..session import lookup_table


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.na.drop("any", subset=list(subset))


def filter_label(df: DataFrame, value, label: str = "label") -> DataFrame:
    return df.where(F.col(label) == value)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def with_literal(df: DataFrame, column: str, value) -> DataFrame:
    return df.withColumn(column, F.lit(value))


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Casts that give null for values that do not fit."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def build_prompts(
    df: DataFrame, standard: str = STANDARD_PROMPT, detailed: str = DETAILED_PROMPT, rewrite: str = REWRITE_PROMPT
) -> DataFrame:
    """Three prompt columns; a null prompt or text gives a null prompt column."""
    return df.withColumns(
        {
            "standard_prompt": F.concat(F.lit(standard), F.col("prompt")),
            "altered_prompt": F.concat(F.lit(detailed), F.col("prompt")),
            "rewrite_prompt": F.concat(F.lit(rewrite), F.col("text")),
        }
    )


def append_columns(df: DataFrame, other: DataFrame, key: str = "doc_id") -> DataFrame:
    """Columns of ``other`` next to those of ``df``, matched on a key."""
    return df.join(other, key, "left")


def expand_map(df: DataFrame, column: str, keys: Sequence[str], default=None) -> DataFrame:
    """One column per declared key; the map column is dropped."""
    picked = {k: F.try_element_at(F.col(column), F.lit(k)) for k in keys}
    if default is not None:
        picked = {k: F.coalesce(c, F.lit(default)) for k, c in picked.items()}
    return df.withColumns(picked).drop(column)


def interpret_score(score: Column | str) -> Column:
    """Below 0.5 human, above 0.5 LLM, exactly 0.5 undefined."""
    s = as_col(score)
    return F.when(s < 0.5, "human").when(s > 0.5, "LLM")


def features_long(df: DataFrame, groups: DataFrame, features: Sequence[str], key: str = "doc_id") -> DataFrame:
    """``key, group, feature, value``: one row per feature with its group."""
    tall = df.select(key, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        key, list(features), "feature", "value"
    )
    return tall.join(lookup_table(groups), "feature").select(key, "group", "feature", "value")


def select_logged_keys(request: Column, response: Column, metric_keys: Column) -> Column:
    """Entries of the two maps whose key is configured; the response wins."""
    kept = F.map_filter(request, lambda k, _v: ~F.array_contains(F.map_keys(response), k))
    return F.map_filter(F.map_concat(kept, response), lambda k, _v: F.array_contains(metric_keys, k))


def union_by_name(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def intersect_keys(a: Column, keys: Column) -> Column:
    return F.array_intersect(F.map_keys(a), keys)


def except_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` that ``right`` does not hold."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact distinct rows; copies are combined in each partition before they move."""
    return (df.select(*columns) if columns else df).distinct()


def sort_by_key(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)


# -- aggregates -------------------------------------------------------------

def first_per_group(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """First non-null value of each column per non-null key, by an explicit order."""
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs).orderBy(key)


def counts_by_source_label(df: DataFrame, labels: Sequence[int] = (0, 1), source: str = "source", label: str = "label") -> DataFrame:
    return df.groupBy(source).agg(*[F.count_if(F.col(label) == v).alias(f"label_{v}") for v in labels])


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(label)


def mean_std_max(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, population std and maximum per key."""
    return df.groupBy(key).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("max")
    )


def mode_first(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Most common value per key; ties go to the value seen first."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(
        F.count("*").alias("n"), F.min(order).alias("_at")
    )
    return counted.groupBy(key).agg(
        F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("n"), "_at")).alias("_m")
    ).select(key, F.col(f"_m.{value}").alias("mode"), F.col("_m.n").alias("n"))


def count_distinct(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Exact distinct counts per key, one de-duplicating shuffle per column set.

    Each column is reduced to its distinct (key, value) pairs first, so a hot
    key is spread over its values instead of landing in one task.
    """
    tall = df.select(
        key, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("e")
    ).select(key, "e.c", "e.v")
    pairs = tall.where("v IS NOT NULL").distinct()
    return pairs.groupBy(key).agg(
        *[F.count_if(F.col("c") == c).alias(f"n_{c}") for c in columns]
    )


def profile(df: DataFrame) -> DataFrame:
    """Row count and non-null count per column in one pass."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(f"non_null_{c}") for c in df.columns])


def best_trial(trials: DataFrame, score: str = "auc", trial: str = "trial") -> DataFrame:
    """The trial with the best score; the earliest wins a tie."""
    cols = trials.columns
    best = trials.agg(F.max_by(F.struct(*cols), F.struct(F.col(score), (-F.col(trial)).alias("t"))).alias("b"))
    return best.select("b.*")


def natural_version_sort(df: DataFrame, url: str = "url") -> DataFrame:
    """Descending by path and the last part padded to nine places (10 after 9)."""
    return df.orderBy(version_sort_key(F.col(url)).desc())


def version_sort_key(url: Column) -> Column:
    parts = F.split(url, "/")
    last = F.element_at(parts, -1)
    # lpad would cut longer parts, so only shorter ones are padded
    padded = F.when(F.length(last) < 9, F.lpad(last, 9, "0")).otherwise(last)
    head = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    return F.when(url.contains("/"), F.concat(head, F.lit("/"), padded)).otherwise(url)
