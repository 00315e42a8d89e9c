"""Similarity of consecutive sentence vectors and its spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.base import let
from ..functions.text import sentences, tokenize
from ..functions.vectors import cosine, std_pop_of
from .tokens import sentence_rows


def consecutive_similarity(
    vectors: DataFrame, key: str = "doc_id", order: str = "sent_id", vec: str = "embedding"
) -> DataFrame:
    """Cosine of each sentence vector with the next one; a window spans one document."""
    w = Window.partitionBy(key).orderBy(order)
    nxt = vectors.withColumn("_next", F.lead(vec).over(w)).where(F.col("_next").isNotNull())
    return nxt.select(key, order, cosine(vec, "_next").alias("similarity"))


def semantic_flow_variability(
    vectors: DataFrame, key: str = "doc_id", order: str = "sent_id", vec: str = "embedding"
) -> DataFrame:
    """Population std of the consecutive similarities; fewer than two sentences give 0.

    Spark's ``stddev_pop`` of one similarity is 0, and a NaN similarity (zero
    vector) stays NaN, as the reference result does.
    """
    w = Window.partitionBy(key).orderBy(order)
    pairs = vectors.withColumn("_next", F.lead(vec).over(w)).select(
        key, F.when(F.col("_next").isNotNull(), cosine(vec, "_next")).alias("similarity")
    )
    return pairs.groupBy(key).agg(
        F.coalesce(F.stddev_pop("similarity"), F.lit(0.0)).alias("semantic_flow_variability")
    )


# One character per slot; a sentence becomes a string of its tokens' slots.
SLOTS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def hashed_vector(tokens: Column, dims: int = 32) -> Column:
    """Hashed term-frequency vector of a token array, inside the row.

    A slot's count is the length the slot string loses without its character.
    """
    if dims > len(SLOTS):
        raise ValueError(f"at most {len(SLOTS)} dimensions")

    def code(t: Column) -> Column:
        slot = F.conv(F.substring(F.md5(F.lower(t)), 1, 8), 16, 10).cast("bigint") % dims
        return F.substr(F.lit(SLOTS), (slot + 1).cast("int"), F.lit(1))

    def counts(codes: Column) -> Column:
        return F.array(
            *[(F.length(codes) - F.length(F.replace(codes, F.lit(ch), F.lit("")))).cast("double") for ch in SLOTS[:dims]]
        )

    return let(F.array_join(F.transform(tokens, code), ""), counts)


def flow_of(vectors: Column) -> Column:
    """Population std of the similarities of neighbouring vectors of one array."""

    def spread(v: Column) -> Column:
        n = F.size(v)
        pairs = F.zip_with(F.slice(v, 1, n - 1), F.slice(v, F.lit(2), n - 1), cosine)
        return F.when(n < 2, F.lit(0.0)).otherwise(std_pop_of(pairs))

    return let(vectors, spread)


def text_flow(text: Column | str, dims: int = 32) -> Column:
    """Semantic flow variability of a text from hashed sentence vectors."""
    return flow_of(F.transform(sentences(text), lambda s: hashed_vector(tokenize(s), dims)))


def sentence_vectors(df: DataFrame, dims: int = 32, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, sent_id, embedding``: hashed vectors for texts without embeddings."""
    return sentence_rows(df, key, text).select(
        key, "sent_id", hashed_vector(tokenize("sentence"), dims).alias("embedding")
    )
