"""Measures that count inside one text with a table at hand: small Arrow functions.

A text stays in its row, so nothing is exploded, joined back or shuffled.  Tables
passed in are checked to be small by the caller.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters up to here are counted in an array, others by sorting.
PLANE = 65_536


def entropy_bits(text: str | None) -> float | None:
    if text is None:
        return None
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        return 0.0
    counts = np.bincount(points) if points.max() < PLANE else np.unique(points, return_counts=True)[1]
    p = counts[counts > 0] / len(points)
    return float(-(p * np.log2(p)).sum()) + 0.0


def character_entropy(text: Column) -> Column:
    """Shannon entropy (bits) of the characters; 0 for an empty text, null for null."""

    def call(texts: pa.Array) -> pa.Array:
        return pa.array([entropy_bits(t) for t in texts.to_pylist()], pa.float64())

    return F.arrow_udf(call, "double")(text)


def token_hits(tokens: Column, table: Mapping[str, Sequence[int]], width: int) -> Column:
    """How many tokens fall in each of ``width`` numbered categories.

    ``tokens`` is a text of tokens joined by single blanks; ``table`` names the
    categories of a token, which may be several.
    """
    table = {t: tuple(c) for t, c in table.items()}

    def call(texts: pa.Array) -> pa.Array:
        hits = np.zeros((len(texts), width), dtype=np.int64)
        for row, text in enumerate(texts.to_pylist()):
            for token in (text or "").split(" "):
                for c in table.get(token, ()):
                    hits[row, c] += 1
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * width)
        return pa.ListArray.from_arrays(offsets, pa.array(hits.ravel()))

    return F.arrow_udf(call, "array<bigint>")(tokens)


def token_numbers(tokens: Column, table: Mapping[str, int], unknown: int) -> Column:
    """The number of each token of a text of tokens joined by single blanks."""
    table = dict(table)

    def call(texts: pa.Array) -> pa.Array:
        return pa.array([[table.get(t, unknown) for t in (x or "").split(" ") if t] for x in texts.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(call, "array<int>")(tokens)


def mapped_tokens(tokens: Column, table: Mapping[str, str], otherwise: Column) -> Column:
    """Tokens replaced by the table of lower-case ones; others come from ``otherwise``, token by token."""
    table = dict(table)

    def call(texts: pa.Array, others: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(texts.to_pylist(), others.to_pylist()):
            out.append(None if a is None else " ".join(table.get(x.lower(), y) for x, y in zip(a.split(" "), b.split(" "))))
        return pa.array(out, pa.string())

    return F.arrow_udf(call, "string")(tokens, otherwise)
