"""Model versions served per url: assignment, stale rows, synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import lookup_table, written
from .ordering import ranked, with_range


def latest_models(models: DataFrame, max_versions: int) -> DataFrame:
    """The ``max_versions`` most recently updated models per url.

    Range counts tell which ranges of the update order can hold them; only rows
    of those ranges are moved and ranked, so a url with most of the models is
    neither sorted nor shuffled as a whole.
    """
    rows = with_range(models, ["updated", "model_id"])
    sizes = rows.groupBy("base_url", "_rng").agg(F.count("*").alias("_n"))
    later = Window.partitionBy("base_url").orderBy(F.desc("_rng")).rowsBetween(Window.unboundedPreceding, -1)
    newer = F.coalesce(F.sum("_n").over(later), F.lit(0))
    kept = sizes.withColumn("_newer", newer).where(F.col("_newer") < max_versions).select("base_url", "_rng")
    few = rows.join(lookup_table(kept), ["base_url", "_rng"]).drop("_rng")
    rank = F.row_number().over(Window.partitionBy("base_url").orderBy(F.desc("updated"), F.desc("model_id")))
    return few.withColumn("_r", rank).where(F.col("_r") <= max_versions).drop("_r")


def known_versions(models: DataFrame, current: DataFrame) -> DataFrame:
    """Models with the version they already have, null for unseen ones."""
    return models.join(current.select("base_url", "model_id", "version"), ["base_url", "model_id"], "left")


def assign_versions(models: DataFrame, current: DataFrame, max_versions: int | None = None) -> DataFrame:
    """``base_url, model_id, version``: known models keep theirs, unseen ones count on.

    Unseen models are numbered oldest first above the highest current version,
    so the most recently updated model gets the highest number.
    """
    wanted = latest_models(models, max_versions) if max_versions else models
    # read several times below
    joined = written(known_versions(wanted.select("base_url", "model_id", "updated"), current), "models")
    top = current.groupBy("base_url").agg(F.max("version").alias("_top"))
    seen = joined.where("version IS NOT NULL").select("base_url", "model_id", F.col("version").cast("bigint").alias("version"))
    fresh = joined.where("version IS NULL").drop("version")
    if max_versions:
        # at most max_versions rows per url
        w = Window.partitionBy("base_url").orderBy("updated", "model_id")
        numbered = fresh.withColumn("_n", F.row_number().over(w))
    else:
        numbered = ranked(fresh, ["updated", "model_id"], ["base_url"], out="_n")
    # one row per url
    new = numbered.join(lookup_table(top), "base_url", "left").select(
        "base_url", "model_id", (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("bigint").alias("version")
    )
    return seen.unionByName(new)


def stale_versions(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """Served versions that are no longer wanted."""
    return current.join(wanted.select("base_url", "version"), ["base_url", "version"], "left_anti")


def sync_versions(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """The served table after a sync: wanted rows, marked kept or added, and removed ones.

    Urls absent from the snapshot are no longer monitored and are removed too.
    """
    old = current.select("base_url", "version", F.col("model_id").alias("_old"))
    new = wanted.select("base_url", "version", F.col("model_id").alias("_new"))
    action = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").otherwise("kept")
    # a version that is already served keeps its model
    return old.join(new, ["base_url", "version"], "full_outer").select(
        "base_url", "version", F.coalesce("_old", "_new").alias("model_id"), action.alias("action")
    )
