"""Exact seeded samples, permutations and splits.

Positions are found on narrow columns first; the wide rows are then kept or
routed by a comparison in the scan, so the data itself is not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.base import draw, draw_hex
from ..session import lookup_table
from .ordering import draw_cuts, draw_cuts_of_whole, draw_ranked

# Draws with replacement that one row stands for.
DRAW_BLOCK = 10_000


def sample_per_label(df: DataFrame, n: int, seed: int, label: str = "label", key: str = "doc_id") -> DataFrame:
    """Exactly ``n`` rows per label (all rows of a smaller label), without replacement."""
    labels = df.select(label).where(F.col(label).isNotNull()).distinct()
    wanted = labels.select(label, F.lit(0).alias("cut"), F.lit(n).cast("bigint").alias("_at"))
    cuts = draw_cuts(df.where(F.col(label).isNotNull()), key, seed, wanted, [label]).select(
        label, F.struct("_h", key).alias("_cut")
    )
    here = F.struct(draw_hex(key, seed).alias("_h"), F.col(key))
    return df.join(lookup_table(cuts), label).where(here <= F.col("_cut")).drop("_cut").select(*df.columns)


def sample_rows(df: DataFrame, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    """Exactly ``n`` rows of the whole table."""
    cut = draw_cuts_of_whole(df, key, seed, lambda total: [n]) if n > 0 else []
    return df.where(_until(df, cut[0], key, seed)) if cut else df.where(F.lit(False))


def _until(df: DataFrame, cut: Row, key: str, seed: int) -> Column:
    """Whether a row is at or before the cut in the seeded order."""
    here = F.struct(draw_hex(key, seed).alias("_h"), F.col(key))
    return here <= F.struct(F.lit(cut["_h"]).alias("_h"), F.lit(cut[key]).cast(df.schema[key].dataType).alias(key))


def sample_per_label_replace(
    df: DataFrame, n: int, seed: int, label: str = "label", key: str = "doc_id"
) -> DataFrame:
    """Exactly ``n`` draws per label with replacement; ``draw_no`` numbers them."""
    known = df.where(F.col(label).isNotNull())
    sizes = known.groupBy(label).agg(F.count("*").alias("_size"))
    # a label's draws come from blocks of their own, so no row or task makes them all
    blocks = sizes.select(label, "_size", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // DRAW_BLOCK))).alias("_block"))
    first, last = F.col("_block") * DRAW_BLOCK + 1, F.least(F.lit(n), (F.col("_block") + 1) * DRAW_BLOCK)
    if n > DRAW_BLOCK:
        blocks = blocks.repartition(label, "_block")
    draws = blocks.select(label, "_size", F.explode(F.sequence(first, last)).alias("cut"))
    tag = F.concat_ws("/", F.col(label).cast("string"), F.col("cut").cast("string"))
    wanted = draws.select(
        label, "cut", (F.floor(draw(tag, seed) * F.col("_size")) + 1).cast("bigint").alias("_at")
    )
    picks = draw_cuts(known, key, seed, wanted, [label]).select(label, key, F.col("cut").alias("draw_no"))
    return df.join(lookup_table(picks), [label, key]).select(*df.columns, "draw_no")


def shuffle(df: DataFrame, seed: int, key: str = "doc_id") -> DataFrame:
    """A full random permutation: a range-partitioned sort by the draw."""
    return df.withColumn("_h", draw_hex(key, seed)).orderBy("_h", key).drop("_h")


def permutation(df: DataFrame, seed: int, key: str = "doc_id", out: str = "position") -> DataFrame:
    """The position each row takes in ``shuffle``."""
    return draw_ranked(df, key, seed, out=out)


def split(
    df: DataFrame, fractions: Sequence[float], seed: int, key: str = "doc_id", names: Sequence[str] | None = None
) -> DataFrame:
    """Disjoint, complete parts with exact sizes ``round(f * n)``; adds ``part``.

    Only the cut rows are located; every row is then routed where it is read.
    """
    if abs(sum(fractions) - 1.0) > 1e-9:
        raise ValueError("fractions must sum to 1")
    names = list(names or [f"part{i}" for i in range(len(fractions))])
    shares, acc = [], 0.0
    for f in fractions[:-1]:
        acc += f
        shares.append(acc)
    ends: list[int] = []

    def wanted(total: int) -> list[int]:
        ends.extend(int(share * total + 0.5) for share in shares)
        return [e for e in ends if e > 0]

    cuts = iter(draw_cuts_of_whole(df, key, seed, wanted))
    bounds = [(name, next(cuts)) for name, e in zip(names, ends) if e > 0]
    part = F.lit(names[-1])
    for name, cut in reversed(bounds):
        part = F.when(_until(df, cut, key, seed), F.lit(name)).otherwise(part)
    return df.withColumn("part", part)


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)
