"""Small tables with the odd cases every operator meets, and plain counterparts."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sentence(rng: random.Random, n: int, letters: str = "abcdefghijklmnop") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_documents(spark, rows):
    """Rows (doc_id, text) with extra columns whose names operators use themselves."""
    data = [(i, t, "en", "s" if (i or 0) % 3 else None, len(t or ""), 1.5, "x", 7, "r", 3) for i, t in rows]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long, id double, rest string, chunk int, row string, uses int"
    )
