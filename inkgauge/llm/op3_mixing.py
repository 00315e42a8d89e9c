"""Temperature mixing of sources, realised as budgeted block permutations.

Shares p of tokens become weights p**e / sum(p**e).  The exponent e is bisected
to the flattest mix whose entropy is at most the target and whose sources are
repeated at most so often.  A source's quota is filled by whole permutations of
its documents and the beginning of one more; the running total of a source's
tokens tells the block of the output a document falls in, so that every block
holds each source at its weight.  Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from . import base
from ..session import written

#: Documents of a source in one range of its permutation, about.
RANGE_ROWS = 500
BLOCK_TOKENS = 1_000_000
STEPS = 40
#: Steps of the bisection that one pass over the sources serves.
LEVELS = 5
#: Hexadecimal digits of a draw: 60 bits.
DIGITS = 15
MAX_REPEATS = 2.0


def draw(*key: Column, seed: int) -> Column:
    """A number of 60 bits from md5, the same in any SQL."""
    text = F.concat_ws(":", *[k.cast("string") for k in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(base.WORD)), F.lit(0)).cast("long")


def spreads_of(sources: DataFrame, exponents: list[float]) -> dict[float, Row]:
    """By exponent, in one pass: the ``total`` of the powers and of the powers times ``logs``, the ``most`` and ``least`` of power to share.

    ``most / least`` is the largest repetition with every document used, over that
    of the source with the fewest, which is used once.  ``top`` is ``most`` as a budget counts it.
    """
    exponent = F.col("exponent")
    power = F.pow(F.col("share"), exponent)
    rows = sources.select("share", F.explode(F.array(*[F.lit(e) for e in exponents])).alias("exponent")).groupBy("exponent").agg(
        F.sum(power).alias("total"), F.sum(power * F.log("share")).alias("logs"), F.max(power / F.col("share")).alias("most"),
        F.min(power / F.col("share")).alias("least"), F.max(F.pow(F.col("share"), exponent - 1.0)).alias("top"),
    )
    return {r.exponent: r for r in rows.collect()}


def middles(low: float, high: float, levels: int) -> list[float]:
    """Every exponent that so many steps of bisection may try."""
    if not levels:
        return []
    middle = (low + high) / 2
    return [middle, *middles(low, middle, levels - 1), *middles(middle, high, levels - 1)]


def bisect_exponent(sources: DataFrame, entropy: float | None, repeats: float | None, budget: int | None, tokens: int) -> float:
    """The smallest exponent in 0 to 1 that meets the limits; 1 where none does.

    A pass over the sources serves ``LEVELS`` steps, as it weighs all exponents
    they may come to.
    """

    def meets(r: Row) -> bool:
        if entropy is not None and math.log(r.total) - r.exponent * r.logs / r.total > entropy + 1e-12:
            return False
        if repeats is None:
            return True
        if budget is not None:
            return budget * r.top / r.total / tokens <= repeats + 1e-12
        return r.most / r.least <= repeats + 1e-12

    low, high = 0.0, 1.0
    ends = spreads_of(sources, [low, high])
    if meets(ends[low]):
        return low
    if not meets(ends[high]):
        return high
    for done in range(0, STEPS, LEVELS):
        levels = min(LEVELS, STEPS - done)
        known = spreads_of(sources, middles(low, high, levels))
        for _ in range(levels):
            middle = (low + high) / 2
            low, high = (low, middle) if meets(known[middle]) else (middle, high)
    return high


def source_weights(
    sizes: DataFrame, entropy: float | None = None, repeats: float | None = MAX_REPEATS, budget: int | None = None
) -> DataFrame:
    """``source, n_docs, tokens, weight, quota`` from ``source, n_docs, tokens``.

    Without a budget it is the least that uses every document of every source.
    Sources without tokens have weight and quota 0.
    """
    known = sizes.where("tokens > 0")
    total = known.agg(F.sum("tokens")).first()[0]
    if not total:
        return sizes.select("source", "n_docs", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"))
    sources = known.withColumn("share", F.col("tokens") / F.lit(total))
    exponent = bisect_exponent(sources, entropy, repeats, budget, total)
    power = F.pow(F.col("share"), F.lit(exponent))
    sums = sources.agg(F.sum(power), F.min(power / F.col("share"))).first()
    # with no budget the source of the smallest weight to share is used once
    whole = budget if budget is not None else total * sums[0] / sums[1]
    share = F.col("tokens") / F.lit(total)
    weight = F.when(F.col("tokens") > 0, F.round(F.pow(share, F.lit(exponent)) / F.lit(sums[0]), 9)).otherwise(0.0)
    quota = F.round(F.pow(share, F.lit(exponent)) / F.lit(sums[0]) * F.lit(float(whole)), 0).cast("long")
    return sizes.select("source", "n_docs", "tokens", weight.alias("weight"), F.when(F.col("tokens") > 0, quota).otherwise(0).alias("quota"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    entropy: float | None = None, repeats: float | None = MAX_REPEATS, budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS, seed: int = 17,
) -> DataFrame:
    """A row for each use of a document: ``id, source, n_tokens, epoch, block, place``.

    Tokens are words.  ``epoch`` counts a source's permutations from 0; ``block``
    and ``place`` order the output.  A document is in the last, partial
    permutation if it ends within the quota.  A null source is a source.  Texts
    without words (null, empty, blank) are used once in each whole permutation,
    and once if their source has no tokens.  Rows of the same id and text are
    different rows, in any order; null ids are ordered by their words.  A text of any
    length is one document: a very long one is used whole or not at all.  Columns
    of ``docs`` other than the three named are not looked at.  An empty table
    gives no rows.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), count_words(F.col(f"`{text_col}`")).alias("n_tokens")
    )
    rows = written(rows, "counted")
    sizes = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    weights = written(source_weights(written(sizes, "sizes"), entropy, repeats, budget), "weights")
    return uses(rows, weights, block_tokens, seed).select("id", "source", "n_tokens", "epoch", "block", "place")


def uses(rows: DataFrame, weights: DataFrame, block_tokens: int, seed: int) -> DataFrame:
    plan = weights.select(
        F.col("source").alias("of"), "n_docs", "tokens", "weight", "quota",
        F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).alias("whole"),
    )
    # few narrow rows: Spark sends them to all tasks if they are as small as it measures
    rows = rows.join(plan, rows.source.eqNullSafe(plan.of)).drop("of")
    last = F.col("quota") - F.col("whole") * F.col("tokens")
    epochs = F.when((F.col("tokens") > 0) & (last > 0), F.col("whole")).otherwise(F.col("whole") - 1)
    rows = rows.where(epochs >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs)))
    rows = rows.withColumn("draw", draw(F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("epoch"), seed=seed))
    ranges = F.ceil(F.col("n_docs") / RANGE_ROWS)
    rows = rows.withColumn("range", F.floor(F.col("draw") / F.lit(float(16**DIGITS)) * ranges))
    sums = rows.groupBy("source", "epoch", "range").agg(F.sum("n_tokens").alias("sum"))
    ahead = Window.partitionBy("source", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("of"), F.col("epoch").alias("of_epoch"), F.col("range").alias("of_range"),
        F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("ahead"),
    )
    within = Window.partitionBy("source", "epoch", "range").orderBy("draw", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    rows = rows.join(
        offsets, rows.source.eqNullSafe(offsets.of) & (rows.epoch == offsets.of_epoch) & (rows.range == offsets.of_range)
    ).withColumn("before", F.col("before") + F.col("ahead"))
    fits = (F.col("epoch") < F.col("whole")) | (F.col("before") + F.col("n_tokens") <= F.col("quota") - F.col("whole") * F.col("tokens"))
    per_block = F.greatest(F.lit(1), F.round(F.col("weight") * block_tokens, 0).cast("long"))
    block = F.floor((F.col("epoch") * F.col("tokens") + F.col("before")) / per_block)
    return rows.where(fits).withColumn("block", block).withColumn("place", F.col("draw"))


MIXING_SQL = rf"""
WITH RECURSIVE counted AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents
), sizes AS (
  SELECT source, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM counted GROUP BY source
), shares AS (
  SELECT tokens / (SELECT sum(tokens) FROM sizes)::DOUBLE AS share FROM sizes WHERE tokens > 0
), ends AS (
  SELECT max(share) / min(share) <= {MAX_REPEATS} + 1e-12 AS flat FROM shares
), bisect(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, CASE WHEN flat THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END FROM ends
  UNION ALL
  SELECT step + 1, CASE WHEN meets THEN low ELSE (low + high) / 2 END, CASE WHEN meets THEN (low + high) / 2 ELSE high END
  FROM (
    SELECT b.*, (SELECT max(pow(share, (b.low + b.high) / 2) / share) / min(pow(share, (b.low + b.high) / 2) / share) FROM shares)
      <= {MAX_REPEATS} + 1e-12 AS meets
    FROM bisect b WHERE b.step < {STEPS}
  )
), found AS (
  SELECT high AS e FROM bisect WHERE step = {STEPS}
), total AS (
  SELECT sum(pow(share, e)) AS s, min(pow(share, e) / share) AS m FROM shares, found
), plan AS (
  SELECT source, n_docs, tokens,
    CASE WHEN tokens > 0 THEN round(pow(tokens / t, e) / s, 9) ELSE 0 END AS weight,
    CASE WHEN tokens > 0 THEN CAST(round(pow(tokens / t, e) / s * (t * s / m)) AS BIGINT) ELSE 0 END AS quota
  FROM sizes, found, total, (SELECT sum(tokens)::DOUBLE AS t FROM sizes)
), wholes AS (
  SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS whole FROM plan
), used AS (
  SELECT c.doc_id, c.source, c.n_tokens, w.tokens, w.weight, w.quota, w.whole,
    unnest(range(CASE WHEN w.tokens > 0 AND w.quota > w.whole * w.tokens THEN w.whole + 1 ELSE w.whole END)) AS epoch
  FROM counted c JOIN wholes w ON c.source IS NOT DISTINCT FROM w.source
), drawn AS (
  SELECT *, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || epoch || ':17'), 1, {DIGITS}))::BIGINT AS draw FROM used
), summed AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY draw, doc_id, n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM drawn
)
SELECT doc_id, source, n_tokens, epoch, CAST(floor((epoch * tokens + before) / greatest(1, round(weight * {BLOCK_TOKENS}))) AS BIGINT) AS block, draw AS place
FROM summed WHERE epoch < whole OR before + n_tokens <= quota - whole * tokens
"""


@base.query("op3_temperature_mixing", MIXING_SQL)
def op3_temperature_mixing(spark, sf_dir: str) -> DataFrame:
    """Uses of all documents: every one at least once, small sources up to twice."""
    out = mix_sources(base.table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id")
