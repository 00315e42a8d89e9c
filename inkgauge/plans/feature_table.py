"""The feature table: one wide row per document.

One scan and one cleaning chain: readability, entropy, density, syntax and the
hits of a lexicon and of familiar words are computed inside the document row, so
nothing is shuffled.  Only a lexicon too large to be shipped is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import EXTRA_TREE_FEATURES, FEATURES, LEXICON_CATEGORIES, READABILITY_FEATURES, TREE_FEATURES
from ..functions import readability as R
from ..functions import text as X
from ..functions.base import safe_div
from ..functions.inrow import mapped_tokens
from ..functions.vectors import std_pop_of
from ..operators.annotate import (
    entity_stats, explode_annotations, noun_chunk_stats, rule_stats, syntax_struct, token_stats, tree_stats,
    written_trees,
)
from ..operators.frame import features_long
from ..operators.flow import semantic_flow_variability, text_flow
from ..operators.tokens import in_row_hits, semantic_density
from ..session import small_rows, spread, written

# Feature -> group shown next to it in a breakdown.
FEATURE_GROUPS = {
    **dict.fromkeys(READABILITY_FEATURES, "Readability Scores"),
    "semantic_density": "Semantic Density",
    "semantic_flow_variability": "Semantic Flow Variability",
    **dict.fromkeys(LEXICON_CATEGORIES, "Psycholinguistic Features"),
    "textual_entropy": "Textual Entropy",
    **dict.fromkeys((*TREE_FEATURES, *EXTRA_TREE_FEATURES), "Syntactic Tree Patterns"),
}

# Marks familiar words inside the joined lexicon; not a category of its own.
FAMILIAR = "__familiar__"


def cleaned(
    df: DataFrame, key: str = "doc_id", text: str = "text", order: str = "batch", lemmas: DataFrame | None = None
) -> DataFrame:
    """``key, clean``; with a table ``lemmas(token, lemma)`` of lower-case tokens instead of the suffix rule alone."""
    if lemmas is None:
        return df.select(key, X.clean_text(text, order).alias("clean"))
    plain = df.select(key, X.clean_text(text, order, lemmatize=False).alias("clean"))
    return lemmatized(plain, lemmas, key)


def lemmatized(plain: DataFrame, lemmas: DataFrame, key: str = "doc_id", column: str = "clean") -> DataFrame:
    """A column of blank-joined tokens with the table's lemmas; the suffix rule for tokens it does not name.

    A table within the bounds of ``small_rows`` is looked up inside the row, a
    larger one by a join of the exploded tokens, put together again by the key and
    a hash of the text, so a key may be in many rows.
    """
    table = written(lemmas.where("token IS NOT NULL AND lemma IS NOT NULL").groupBy("token").agg(F.min("lemma").alias("lemma")), "lemmas")
    rows = small_rows(table)
    by_rule = X.lemmatize_text(F.col(column))
    if rows is not None:
        return plain.withColumn(column, mapped_tokens(F.col(column), {r["token"]: r["lemma"] for r in rows}, by_rule))
    pairs = F.arrays_zip(F.split(column, " ").alias("t"), F.split(by_rule, " ").alias("r"))
    own = plain.select(F.col(key).alias("_key"), F.xxhash64(column).alias("_text"), column).dropDuplicates(["_key", "_text"])
    tokens = own.select("_key", "_text", F.posexplode(pairs).alias("pos", "p")).select("_key", "_text", "pos", F.lower("p.t").alias("token"), "p.r")
    named = tokens.join(table, "token", "left").groupBy("_key", "_text").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.coalesce("lemma", "r").alias("t")))).alias("_t")
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.xxhash64(column) == F.col("_text"))
    return plain.join(named, same, "left").select(*[c for c in plain.columns if c != column], F.array_join("_t.t", " ").alias(column))


def annotated_features(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """The token, entity, chunk and tree features of annotated sentences, one row per document.

    The sentences are written once for all parts, and so are the shapes of their trees.
    """
    sents = written(sents, "annotations")
    tokens, trees = explode_annotations(sents, key), written_trees(sents, key)
    out = token_stats(tokens, key)
    for part in (entity_stats(tokens, key), noun_chunk_stats(tokens, key), tree_stats(trees, key), rule_stats(trees, key)):
        out = out.join(part, key, "left")
    return out


def row_features(clean: DataFrame, key: str = "doc_id", with_flow: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Everything that needs only the document itself, besides the columns to ``keep``."""
    flow = [text_flow("clean").alias("semantic_flow_variability")] if with_flow else []
    staged = clean.select(
        key,
        X.text_counts("clean").alias("counts"),
        X.textual_entropy("clean").alias("textual_entropy"),
        X.density_of(X.tokenize(F.lower("clean"))).alias("semantic_density"),
        *flow,
        *keep,
        syntax_struct(F.col("clean")).alias("syn"),
    )
    return staged.select(
        key,
        "counts.*",
        "textual_entropy",
        "semantic_density",
        *(["semantic_flow_variability"] if with_flow else []),
        *keep,
        "syn.*",
    ).select(
        "*",
        std_pop_of(F.col("_depths")).alias("depth_variability"),
        std_pop_of(F.col("_spines")).alias("tree_height_variability"),
    ).drop("_depths", "_spines")


def lookup_counts(
    clean: DataFrame, lexicon: DataFrame, familiar: DataFrame, categories: Sequence[str] = LEXICON_CATEGORIES,
    key: str = "doc_id", lemmas: DataFrame | None = None,
) -> DataFrame:
    """``clean`` with the array ``_hits``: one count for each category and a last one for familiar words.

    Words of both tables meet the text in its own form: they take the same lemma
    step as the text.
    """
    table = lexicon.select("category", "token").unionByName(familiar.select(F.lit(FAMILIAR).alias("category"), "token"))
    if lemmas is None:
        table = table.select("category", F.lower(X.lemmatize_text("token")).alias("token"))
    else:
        table = lemmatized(table, lemmas, "category", "token").select("category", F.lower("token").alias("token"))
    return in_row_hits(clean, F.lower("clean"), table, [*categories, FAMILIAR], key)


def feature_table(
    df: DataFrame,
    lexicon: DataFrame,
    familiar: DataFrame,
    categories: Sequence[str] = LEXICON_CATEGORIES,
    key: str = "doc_id",
    text: str = "text",
    order: str = "batch",
    with_flow: bool = False,
    annotations: DataFrame | None = None,
    lemmas: DataFrame | None = None,
    tags: DataFrame | None = None,
    vectors: DataFrame | None = None,
    clean: DataFrame | None = None,
) -> DataFrame:
    """``key``, the ordered features and ``most_common_rule``, one row per document.

    ``lexicon(category, token)`` and ``familiar(token)`` are inputs; ``categories``
    is declared, so no job runs to discover the columns.  ``with_flow`` adds
    ``semantic_flow_variability`` from hashed sentence vectors.

    The rules that stand in for language data give way to tables where these are
    given: ``annotations`` (sentence rows as ``collect_annotations`` makes them)
    for every token, entity, chunk and tree feature, ``lemmas(token, lemma)`` in
    cleaning, ``tags(token, tag)`` in the density, ``vectors(key, sent_id,
    embedding)`` in the flow.  A document that a table does not name has zeros,
    and NaN for spreads.  ``clean(key, clean)`` are the cleaned texts where a caller has
    them already; they are not cleaned again.
    """
    rows = cleaned(spread(df.select(key, text), key), key, text, order, lemmas) if clean is None else spread(clean, key)
    counted = lookup_counts(rows, lexicon, familiar, categories, key, lemmas)
    joined = row_features(counted, key, with_flow or vectors is not None, ["_hits"])
    if annotations is not None:
        joined = _replaced(joined, annotated_features(annotations, key), key)
    if tags is not None:
        joined = _replaced(joined, semantic_density(rows, tags, key, "clean"), key)
    if vectors is not None:
        joined, with_flow = _replaced(joined, semantic_flow_variability(vectors, key=key), key), True
    w, s = F.col("n_words"), F.col("n_sentences")
    difficult = w - F.get("_hits", F.lit(len(categories)))
    scores = {
        "flesch_kincaid_grade": R.flesch_kincaid_grade(w, s, F.col("n_syllables")),
        "gunning_fog": R.gunning_fog(w, s, F.col("n_polysyllables")),
        "coleman_liau_index": R.coleman_liau_index(w, s, F.col("n_letters")),
        "smog_index": R.smog_index(s, F.col("n_polysyllables")),
        "ari": R.ari(w, s, F.col("n_characters")),
        "dale_chall": R.dale_chall(w, s, difficult),
    }
    return joined.select(
        key,
        *[scores[f].alias(f) for f in READABILITY_FEATURES],
        "textual_entropy",
        "semantic_density",
        *(["semantic_flow_variability"] if with_flow else []),
        *TREE_FEATURES,
        *EXTRA_TREE_FEATURES,
        "most_common_rule",
        *[safe_div(F.get("_hits", F.lit(i)), F.col("num_tokens")).alias(c) for i, c in enumerate(categories)],
    )


def _replaced(df: DataFrame, part: DataFrame, key: str) -> DataFrame:
    """``df`` with the columns of ``part``, by key, in place of its own."""
    names = [c for c in part.columns if c != key and c in df.columns]
    part = part.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in names])
    kinds = dict(df.dtypes)

    def filled(c: str) -> Column:
        new = F.col(f"_new_{c}")
        if c in ("depth_variability", "tree_height_variability"):
            return F.coalesce(new, F.lit(float("nan")))
        return new if kinds[c] == "string" else F.coalesce(new, F.lit(0)).cast(kinds[c])

    joined = df.drop(*names).join(part, F.col(key) == F.col("_key"), "left")
    return joined.select(*[c for c in df.columns if c not in names], *[filled(c).alias(c) for c in names])


def feature_breakdown(features: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, group, feature, value`` for the features present in the table."""
    present = [f for f in FEATURE_GROUPS if f in features.columns]
    groups = features.sparkSession.createDataFrame([(f, FEATURE_GROUPS[f]) for f in present], "feature string, group string")
    return features_long(features, groups, present, key)


def feature_projection(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """The ordered feature list, every column once."""
    return df.select(*dict.fromkeys(features))
