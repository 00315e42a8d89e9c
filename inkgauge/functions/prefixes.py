"""Which of many prefixes a text begins with: one walk down a tree of characters in the row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Under this key a node of the tree names the prefix that ends there.
END = ""


def prefix_tree(prefixes: Iterable[str]) -> dict:
    """Nested dictionaries by character."""
    root: dict = {}
    for prefix in prefixes:
        at = root
        for c in prefix:
            at = at.setdefault(c, {})
        at[END] = prefix
    return root


def prefixes_of(text: str, tree: dict) -> Iterator[str]:
    """The prefixes in the tree that ``text`` begins with, the shortest first."""
    if END in tree:
        yield tree[END]
    for c in text:
        tree = tree.get(c)
        if tree is None:
            return
        if END in tree:
            yield tree[END]


def matched_prefixes(text: Column, prefixes: Iterable[str]) -> Column:
    """All of ``prefixes`` that a text begins with; none for a null text."""
    tree = prefix_tree(prefixes)

    def call(texts: pa.Array) -> pa.Array:
        return pa.array([[] if t is None else list(prefixes_of(t, tree)) for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(call, "array<string>")(text)


def first_match(text: Column, exact: Mapping[str, int], prefixes: Mapping[str, int]) -> Column:
    """The number of the text itself if ``exact`` has it, else the smallest of the prefixes it begins with."""
    exact, prefixes = dict(exact), dict(prefixes)
    tree = prefix_tree(prefixes)

    def call(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            found = None if t is None else exact.get(t)
            if found is None and t is not None:
                found = min((prefixes[p] for p in prefixes_of(t, tree)), default=None)
            out.append(found)
        return pa.array(out, pa.int64())

    return F.arrow_udf(call, "bigint")(text)
