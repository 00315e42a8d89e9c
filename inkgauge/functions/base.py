"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it as a variable in ``body``.

    Without it the optimizer may inline an array expression into a lambda, which
    would then be evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def safe_div(a: Column, b: Column) -> Column:
    """``a / b`` as a double, 0 when the denominator is 0."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))


def draw_hex(key: Column | str, seed: int | str) -> Column:
    """The md5 of ``key:seed``: a seeded uniform order that any engine can repeat."""
    return F.md5(F.concat(as_col(key).cast("string"), F.lit(f":{seed}")))


def draw(key: Column | str, seed: int | str) -> Column:
    """A reproducible uniform number in [0, 1)."""
    return F.conv(F.substring(draw_hex(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
