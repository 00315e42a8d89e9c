"""Substring dedup by fixed-block anchors.

Every document is an index of non-overlapping blocks of ``window // 2`` words;
every rolling window of a block's length of every document probes it.  A window
of the searched length holds a whole block of any document that has it too, so
no repeat is missed.  A hit is extended to all windows around it; runs of
windows that an earlier document has are the maximal exact repeats.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .repeats import remove_repeats
from .words import Words

WINDOW = 50


def block_anchors(words: Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, same = words.windows(block)
    place = np.arange(len(hashes)) - words.begin[words.doc[: len(hashes)]]
    return hashes, same, same & (place % block == 0)


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, join_words: bool = True
) -> DataFrame:
    """Words covered by a window of ``window`` words that a document of a smaller id has too go.

    Returns what :func:`repeats.remove_repeats` does.  A text of fewer words than
    the window, a blank, empty or null one keeps all it has; an empty table gives
    no rows; of several equal texts only the one of the smallest id stays whole.
    """
    block = window // 2
    return remove_repeats(docs, id_col, text_col, partial(block_anchors, block=block), window, window - block, 1, join_words)


@base.query("op2_substring_dedup")
def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact repeats of 50 words removed from later documents, whole table."""
    out = substring_dedup(base.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), "spans"
    )
