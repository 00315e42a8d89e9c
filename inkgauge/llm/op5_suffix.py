"""Suffix dedup by sparse suffixes at content-selected positions.

A suffix is kept where the hash of its first ``prefix`` words is the smallest of
``window - prefix + 1`` consecutive ones (all of ties).  Two equal windows select
the same place, so about 2 of ``window - prefix`` suffixes are enough.  Two kept
suffixes begin with the same words where their fingerprints are equal; those that
do are extended to the left and right over all windows that selected them.

Fingerprints stand in for a sorted order of the suffixes: a row of a suffix with
the words to its left and right is about five times the text, which is beyond the
disk that this operator may use, so suffixes are not sorted and not compared with
their neighbours.  What is found and removed is the same.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .repeats import remove_repeats
from .words import Words, mix, U

WINDOW, PREFIX = 50, 20


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` consecutive values, by doubled lengths."""
    size, out = 1, values
    while 2 * size <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    if size < width:
        n = len(values) - width + 1
        out = np.minimum(out[:n], out[width - size : width - size + n])
    return out


def minimiser_anchors(words: Words, prefix: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, same = words.windows(prefix)
    width = window - prefix + 1
    kept = np.zeros(len(hashes), dtype=bool)
    if len(words) >= window:
        order = mix(hashes ^ U(0x632BE59BD9B4E019))
        least = sliding_least(order, width)
        whole = words.doc[: len(least)] == words.doc[window - 1 :][: len(least)]
        # a place is kept if a window that is whole has its minimum there; ties keep all equal places
        n = len(hashes)
        best = np.full(n + width, 0, dtype=U)
        best[width - 1 : width - 1 + len(least)] = np.where(whole, least, U(0))
        top = sliding_greatest(best, width)[:n]
        # largest minimum of the windows over a place equals its own order exactly if it is one's minimum
        kept = same & (order == top)
    return hashes, kept, kept


def sliding_greatest(values: np.ndarray, width: int) -> np.ndarray:
    return ~sliding_least(~values, width)


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX,
    join_words: bool = True,
) -> DataFrame:
    """Words of passages of ``window`` or more words that a document of a smaller id has too go.

    Returns what :func:`repeats.remove_repeats` does, with its rules for nulls,
    ties, repeated rows and empty tables.
    """
    anchors = partial(minimiser_anchors, prefix=prefix, window=window)
    return remove_repeats(docs, id_col, text_col, anchors, window, window - prefix, 1 / 8, join_words)


@base.query("op5_suffix_dedup")
def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words and more found by sparse suffixes, whole table."""
    out = suffix_dedup(base.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), "spans"
    )
