"""Canary targets, weights and seeded request routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.base import draw
from ..functions.prefixes import matched_prefixes
from ..session import lookup_table, small_rows
from .frame import version_sort_key


def existing_targets(canary: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Targets that exist, with weights renormalised per canary.

    ``canary(endpoint, ord, target, weight)``; a canary's targets are as many as
    its configured weights.
    """
    live = canary.join(endpoints.select(F.col("url").alias("target")).distinct(), "target", "left_semi")
    total = F.sum("weight").over(Window.partitionBy("endpoint"))
    return live.select("endpoint", "ord", "target", F.try_divide(F.col("weight"), total).alias("weight"))


def rank_prefix_targets(canary: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Newest endpoints under a prefix, one per configured weight.

    ``canary(endpoint, prefix, weights)``.  Each url walks down one tree of the
    prefixes and joins only those it begins with; more prefixes than ``small_rows``
    allows are joined by the lengths that occur.  Versions sort as numbers (10 after
    9), newest first; weights are renormalised over the targets found.
    """
    cfg = lookup_table(canary.where("prefix is not null").select("endpoint", F.col("prefix").alias("_p"), "weights"))
    known = small_rows(lookup_table(cfg.select("_p").distinct()))
    if known is not None:
        begins = matched_prefixes(F.col("url"), [r["_p"] for r in known])
    else:
        lengths = sorted(r[0] for r in cfg.select(F.length("_p")).distinct().collect())
        begins = F.array_compact(F.array(*[F.when(F.length("url") >= n, F.left("url", F.lit(n))) for n in lengths]))
    options = endpoints.select("url").where("url is not null").distinct().select("url", F.explode(begins).alias("_p"))
    hits = options.join(cfg, "_p").withColumn("_key", version_sort_key(F.col("url")))
    top = F.row_number().over(Window.partitionBy("endpoint").orderBy(F.desc("_key"), F.desc("url")))
    # the rank filter is pushed below the shuffle as a per-partition limit
    limit = max([r["n"] for r in canary.agg(F.max(F.size("weights")).alias("n")).collect() if r["n"]] or [0])
    ranks = hits.withColumn("ord", top).where(F.col("ord") <= limit).where(F.col("ord") <= F.size("weights"))
    weighted = ranks.withColumn("weight", F.element_at("weights", F.col("ord")).cast("double"))
    total = F.sum("weight").over(Window.partitionBy("endpoint"))
    return weighted.select("endpoint", "ord", F.col("url").alias("target"), F.try_divide("weight", total).alias("weight"))


def cumulative_weights(targets: DataFrame) -> DataFrame:
    """Intervals ``[lo, hi)`` of the unit range, in target order."""
    w = Window.partitionBy("endpoint").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    hi = F.sum("weight").over(w)
    return targets.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("weight"))


def route_canary(requests: DataFrame, targets: DataFrame, seed: int, key: str, url: str = "url") -> DataFrame:
    """Adds ``routed``: the drawn target, or the url itself where no canary is set.

    The targets of a canary travel as one small array, so a request meets one
    row and keeps its place: no range join and no fan-out.
    """
    folded = (
        cumulative_weights(targets)
        .groupBy("endpoint")
        .agg(F.sort_array(F.collect_list(F.struct("ord", "lo", "hi", "target"))).alias("_t"))
        .withColumnRenamed("endpoint", url)
    )
    u = draw(key, seed)
    joined = requests.withColumn("_u", u).join(lookup_table(folded), url, "left")
    hit = F.get(F.filter("_t", lambda t: F.col("_u") < t["hi"]), F.lit(0))["target"]
    # rounding may leave the last bound just below 1
    last = F.try_element_at("_t", F.lit(-1))["target"]
    return joined.withColumn("routed", F.coalesce(hit, last, F.col(url))).drop("_u", "_t")
