"""Registry, table access and sizing shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Text a task holds at once where texts are dealt to chunks.
CHUNK_CHARS = 4_000_000
#: Chunks and buckets there are at least, so that a small table still uses all cores.
LEAST_PARTS = 64

#: White space between words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its equivalent on the same tables."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def total_chars(df: DataFrame, text: str) -> int:
    """Code points of all texts: the only thing sizes are derived from."""
    return df.agg(F.sum(F.length(text))).first()[0] or 0


def parts_for(total: float, each: float) -> int:
    """Parts of about ``each``, in proportion to ``total`` at every size."""
    return max(LEAST_PARTS, int(-(-total // each)))


def hash_part(key: Column, parts: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(parts)).cast("int")


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """crc32 of the id as text falls in the held-out fold; null ids are not held out."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % folds == fold, F.lit(False))


def grouped(f):
    """``f(key, table)`` in the form that ``applyInArrow`` of a grouping takes."""

    def call(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return f(key, table)

    return call


def cogrouped(f):
    """``f(key, left, right)`` in the form that ``applyInArrow`` of two groupings takes."""

    def call(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        return f(key, left, right)

    return call


def loose(kind: pa.DataType) -> pa.DataType:
    """The type with every nested field nullable, as the results of Python functions are."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, loose(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, loose(kind.value_type)))
    if pa.types.is_map(kind):
        return pa.map_(loose(kind.key_type), pa.field("value", loose(kind.item_type)))
    return kind
