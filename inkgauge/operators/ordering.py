"""Exact ranks, prefix sums and seeded draws without a single-task window.

A window over a huge group sorts that group in one task.  Here rows are first
put into many ordered ranges; only small per-range totals are accumulated, and
rows are ordered inside their own range.  Range bounds are literals, so a task
that is run again after an executor loss assigns the same ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.base import draw_hex, let
from ..session import lookup_table

# Ranges of a distributed order at least; each is sorted by its own task.
MIN_RANGES = 64
SAMPLE_PER_RANGE = 40
# Bounds in one compiled tree; with more, each tree leaf searches a block of at least so many bounds.
TREE_BOUNDS, BLOCK = 128, 8
# Hex digits of a draw that name its bucket, and those of an md5.
DRAW_DIGITS, HEX_DIGITS = 3, 32
# Rows of a bucket that one task orders, about; a larger bucket is divided by further digits.
BUCKET_ROWS = 200_000


def default_ranges(df: DataFrame) -> int:
    """As many ranges as shuffle partitions, which grow with the data, but not too few."""
    return max(MIN_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def range_bounds(df: DataFrame, order: Sequence[str], ranges: int) -> list[tuple]:
    """Ordered bounds taken from a hashed sample of the order keys.

    The sample has a fixed size, so the driver sees a bounded number of keys.
    The keys must be (nearly) unique; aggregate ties away or add an id first.
    """
    n = ranges * SAMPLE_PER_RANGE
    keys = df.select(*order).na.drop()
    sample = keys.orderBy(F.xxhash64(*order)).limit(n).toArrow()
    picked = df.sparkSession.createDataFrame(sample, schema=keys.schema).orderBy(*order).collect()
    step = max(1, len(picked) // ranges)
    return [tuple(r) for r in picked[step::step]]


def _before(order: Sequence[str], bound: Sequence[Column]) -> Column:
    """Whether a row sorts before a bound by all its keys, nulls first."""
    c, b = F.col(order[0]), bound[0]
    if len(order) == 1:
        return c.isNull() | (c < b)
    return c.isNull() | (c < b) | ((c == b) & _before(order[1:], bound[1:]))


def with_range(df: DataFrame, order: Sequence[str], ranges: int | None = None, out: str = "_rng") -> DataFrame:
    """Adds the number of the range a row falls in, ascending with the order.

    The bounds form a balanced decision tree of compiled comparisons.  The first
    key decides alone, except between bounds that share it (a hot value), which
    the further keys split.  The JVM does not compile very long methods, so the
    tree stays small and many bounds are searched in two steps.
    """
    fields = df.select(*order).schema.fields
    types = [f.dataType for f in fields]
    every = range_bounds(df, order, ranges or default_ranges(df))
    block_size = max(BLOCK, -(-len(every) // TREE_BOUNDS))
    values = every if len(every) <= TREE_BOUNDS else every[block_size - 1 :: block_size]
    first = F.col(order[0])

    def before(i: int) -> Column:
        lits = [F.lit(v).cast(t) for v, t in zip(values[i], types)]
        near = [values[j][0] for j in (i - 1, i + 1) if 0 <= j < len(values)]
        return _before(order, lits) if values[i][0] in near else first < lits[0]

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(before(mid), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    found = tree(0, len(values))
    if len(every) > TREE_BOUNDS:
        table = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in every])

        def within(block: Column) -> Column:
            near = F.slice(table, block * block_size + 1, block_size)
            return block * block_size + let(F.struct(*order), lambda key: F.size(F.filter(near, lambda b: b <= key)))

        found = let(found, within)
    return df.withColumn(out, F.when(first.isNull(), F.lit(0)).otherwise(found))


def _offsets(sizes: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums over the preceding ranges of the same group (a few rows per group)."""
    before = Window.partitionBy(*group).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *group, "_rng", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_off_{v}") for v in values]
    )


def ranked(
    df: DataFrame, order: Sequence[str], group: Sequence[str] = (), out: str = "rank", ranges: int | None = None
) -> DataFrame:
    """Exact ``row_number`` by ``order`` within ``group``, spread over ranges."""
    group = list(group)
    rows = with_range(df, order, ranges)
    sizes = rows.groupBy(*group, "_rng").agg(F.count("*").alias("_n"))
    # one row per group and range: a broadcast unless there are very many groups
    offsets = lookup_table(_offsets(sizes, group, ["_n"]))
    w = Window.partitionBy(*group, "_rng").orderBy(*order)
    return (
        rows.join(offsets, [*group, "_rng"])
        .withColumn(out, F.col("_off__n") + F.row_number().over(w))
        .drop("_rng", "_off__n")
    )


def running_sums(
    df: DataFrame, order: Sequence[str], sums: dict[str, str], ranges: int | None = None
) -> DataFrame:
    """Inclusive running sums in ``order``: ``{output: input}``, spread over ranges."""
    rows = with_range(df, order, ranges)
    totals = rows.groupBy("_rng").agg(*[F.sum(v).alias(v) for v in dict.fromkeys(sums.values())])
    offsets = _offsets(totals, [], list(dict.fromkeys(sums.values())))
    w = Window.partitionBy("_rng").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # a row a range
    joined = rows.join(F.broadcast(offsets), "_rng")
    for out, v in sums.items():
        joined = joined.withColumn(out, F.col(f"_off_{v}") + F.sum(v).over(w))
    return joined.drop("_rng", *[f"_off_{v}" for v in sums.values()])


# -- seeded random order ----------------------------------------------------

def with_draw(df: DataFrame, key: str, seed: int | str) -> DataFrame:
    """Adds ``_h``, the draw, which repeats exactly."""
    return df.withColumn("_h", draw_hex(key, seed))


def bucket_of(digits: int) -> Column:
    return F.substring("_h", 1, digits)


def draw_histogram(rows: DataFrame, group: Sequence[str], digits: int) -> DataFrame:
    """``group, _b, _n, _before``: rows per bucket, and those of the group's buckets before it.

    Sums run over the buckets that share all but their last digits, then over those
    groups of buckets, so a window never holds more than 4096 rows.
    """
    hist = rows.withColumn("_b", bucket_of(digits)).groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(_earlier(group, "_b")), F.lit(0))
    if digits <= DRAW_DIGITS:
        return hist.withColumn("_before", before)
    parent = F.substring("_b", 1, digits - DRAW_DIGITS).alias("_up")
    sums = hist.groupBy(*group, parent).agg(F.sum("_n").alias("_n"))
    above = sums.withColumn("_above", F.coalesce(F.sum("_n").over(_earlier(group, "_up")), F.lit(0))).drop("_n")
    inner = hist.withColumn("_up", parent)
    inner = inner.withColumn("_in", F.coalesce(F.sum("_n").over(_earlier([*group, "_up"], "_b")), F.lit(0)))
    return inner.join(above, [*group, "_up"]).withColumn("_before", F.col("_above") + F.col("_in")).drop("_up", "_above", "_in")


def _earlier(group: Sequence[str], order: str):
    return Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def draw_ranked(df: DataFrame, key: str, seed: int | str, group: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Position of every row in the seeded random order of its group."""
    rows, digits = with_draw(df, key, seed), DRAW_DIGITS
    hist = lookup_table(draw_histogram(rows, group, digits))
    if (hist.agg(F.max("_n")).first()[0] or 0) > BUCKET_ROWS:
        digits = 2 * DRAW_DIGITS
        hist = lookup_table(draw_histogram(rows, group, digits))
    rows = rows.withColumn("_b", bucket_of(digits))
    w = Window.partitionBy(*group, "_b").orderBy("_h", key)
    return (
        rows.join(hist.drop("_n"), [*group, "_b"])
        .withColumn(out, F.col("_before") + F.row_number().over(w))
        .drop("_h", "_b", "_before")
    )


def buckets_of_positions(hist: DataFrame, asks: DataFrame, group: Sequence[str]) -> DataFrame:
    """``group, cut, _b, _nth, _n``: the bucket of every asked position, and the position in it.

    Positions and buckets meet in equal steps of the group's rows, a few buckets a
    step; positions beyond the end of a group are its last one.
    """
    sizes = hist.groupBy(*group).agg(F.sum("_n").alias("_total")).withColumn("_step", F.ceil(F.col("_total") / 16**DRAW_DIGITS))
    first, last = F.floor(F.col("_before") / F.col("_step")), F.floor((F.col("_before") + F.col("_n") - 1) / F.col("_step"))
    spans = hist.join(sizes, [*group]).select(*group, "_b", "_n", "_before", F.explode(F.sequence(first, last)).alias("_at_step"))
    asked = asks.join(sizes, [*group]).withColumn("_at", F.least("_at", "_total"))
    asked = asked.select(*group, "cut", "_at", F.floor((F.col("_at") - 1) / F.col("_step")).alias("_at_step"))
    inside = (F.col("_at") > F.col("_before")) & (F.col("_at") <= F.col("_before") + F.col("_n"))
    return asked.join(spans, [*group, "_at_step"]).where(inside).select(*group, "cut", "_b", (F.col("_at") - F.col("_before")).alias("_nth"), "_n")


def draw_cuts(
    df: DataFrame, key: str, seed: int | str, wanted: DataFrame, group: Sequence[str] = ()
) -> DataFrame:
    """The row at each wanted position of the seeded order: ``group, cut, _h, key``.

    ``wanted(group, cut, _at)`` names positions.  Narrow scans: bucket sizes first,
    then, as long as a bucket that holds a position has more than ``BUCKET_ROWS``
    rows, the sizes of its parts by further digits; only the rows of the last
    buckets are ranked.  Positions beyond the group's end give its last row.
    """
    if not group:
        whole = df.select(key).withColumn("_all", F.lit(0))
        return draw_cuts(whole, key, seed, wanted.withColumn("_all", F.lit(0)), ["_all"]).drop("_all")
    group = list(group)
    rows = with_draw(df.select(key, *group), key, seed)
    digits, inside = DRAW_DIGITS, group
    targets = lookup_table(buckets_of_positions(draw_histogram(rows, group, digits), wanted, group))
    while digits + DRAW_DIGITS <= HEX_DIGITS and (targets.agg(F.max("_n")).first()[0] or 0) > BUCKET_ROWS:
        inside = [*group, "_up"]
        held = targets.select(*group, F.col("_b").alias("_up")).distinct()
        scope = rows.withColumn("_up", bucket_of(digits)).join(held, inside, "left_semi")
        digits += DRAW_DIGITS
        hist = scope.withColumn("_b", bucket_of(digits)).groupBy(*inside, "_b").agg(F.count("*").alias("_n"))
        hist = hist.withColumn("_before", F.coalesce(F.sum("_n").over(_earlier(inside, "_b")), F.lit(0)))
        asks = targets.select(*group, F.col("_b").alias("_up"), "cut", F.col("_nth").alias("_at"))
        targets = lookup_table(buckets_of_positions(hist, asks, inside).drop("_up"))
    ranks = rows.withColumn("_b", bucket_of(digits)).join(targets.select(*group, "_b").distinct(), [*group, "_b"], "left_semi")
    ranks = ranks.withColumn("_nth", F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", key)))
    return ranks.join(targets, [*group, "_b", "_nth"]).select(*group, "cut", "_h", key)


def draw_cuts_of_whole(df: DataFrame, key: str, seed: int | str, wanted: Callable[[int], Sequence[int]]) -> list[Row]:
    """The rows ``_h, key`` at the positions that ``wanted`` names for the number of all rows.

    The same search for a few positions of one order: the driver holds 4096 counts a
    position, and two scans are enough unless a bucket has more than ``BUCKET_ROWS`` rows.
    Positions beyond the end give the last row; without rows there is none.
    """
    rows, digits = with_draw(df.select(key), key, seed), DRAW_DIGITS

    def counts(inside: Sequence[str]) -> list[tuple[str, int]]:
        some = rows.where(bucket_of(digits - DRAW_DIGITS).isin(*inside)) if inside else rows
        return sorted((r["_b"], r["_n"]) for r in some.groupBy(bucket_of(digits).alias("_b")).agg(F.count("*").alias("_n")).collect())

    hist = counts([])
    total = sum(n for _, n in hist)
    if not total:
        return []
    asked = [(i, "", min(at, total)) for i, at in enumerate(wanted(total))]
    while True:
        sizes, found = dict(hist), []
        for i, up, at in asked:
            for bucket, n in hist:
                if bucket.startswith(up):
                    if at <= n:
                        found.append((i, bucket, at))
                        break
                    at -= n
        if digits + DRAW_DIGITS > HEX_DIGITS or all(sizes[b] <= BUCKET_ROWS for _, b, _ in found):
            break
        digits += DRAW_DIGITS
        asked, hist = found, counts(sorted({b for _, b, _ in found}))
    near = rows.withColumn("_b", bucket_of(digits)).where(F.col("_b").isin(*sorted({b for _, b, _ in found})))
    near = near.withColumn("_nth", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    places = F.array(*[F.struct(F.lit(b).alias("_b"), F.lit(at).alias("_nth")) for _, b, at in found])
    kept = {(r["_b"], r["_nth"]): r for r in near.where(F.array_contains(places, F.struct("_b", "_nth"))).select("_b", "_nth", "_h", key).collect()}
    return [kept[b, at] for _, b, at in found]
