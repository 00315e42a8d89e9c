"""Token rows, lexicon and familiar-word joins, vocabulary and id encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.base import safe_div
from ..functions.inrow import token_hits, token_numbers
from ..session import lookup_table, small_rows, written
from .lemmas import with_ending_lemmas


def sentence_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sentence: ``key, sent_id`` (1-based), ``sentence``."""
    return df.select(key, F.posexplode(X.sentences(text)).alias("p", "sentence")).select(
        key, (F.col("p") + 1).alias("sent_id"), "sentence"
    )


def token_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per token: ``key, sent_id, pos`` (1-based in the sentence), ``token``."""
    sents = sentence_rows(df, key, text)
    return sents.select(key, "sent_id", F.posexplode(X.tokenize("sentence")).alias("p", "token")).select(
        key, "sent_id", (F.col("p") + 1).alias("pos"), "token"
    )


def lemmatize_tokens(tokens: DataFrame, lemmas: DataFrame, endings: DataFrame | None = None) -> DataFrame:
    """Adds ``lemma`` from a ``(token, lemma)`` table; elsewhere by ``endings`` learned from one, or the suffix rule."""
    known = lookup_table(lemmas.select(F.col("token"), F.col("lemma").alias("_lemma")).dropDuplicates(["token"]))
    if endings is not None:
        found = with_ending_lemmas(tokens, endings).join(known, "token", "left")
        return found.withColumn("lemma", F.coalesce("_lemma", "lemma")).select(*tokens.columns, "lemma")
    return (
        tokens.join(known, "token", "left")
        .withColumn("lemma", F.coalesce("_lemma", X.lemma(F.col("token"))))
        .drop("_lemma")
    )


def tag_tokens(tokens: DataFrame, tags: DataFrame) -> DataFrame:
    """Adds ``tag`` from a ``(token, tag)`` table, suffix rule elsewhere."""
    known = lookup_table(tags.select(F.col("token"), F.col("tag").alias("_tag")).dropDuplicates(["token"]))
    return (
        tokens.join(known, "token", "left")
        .withColumn("tag", F.coalesce("_tag", X.suffix_tag(F.col("token"))))
        .drop("_tag")
    )


def lexicon_hits(tokens: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits per document and category; a word may belong to many categories.

    The lexicon is the (checked) small side.  Only hits are counted, and they
    are combined before the shuffle, so what moves is at most one row per
    document and category found in a partition.
    """
    lex = lookup_table(lexicon.select("category", "token").distinct())
    return (
        tokens.select(key, F.lower("token").alias("token"))
        .join(lex, "token")
        .groupBy(key, "category")
        .agg(F.count("*").alias("hits"))
    )


def lexicon_counts(
    tokens: DataFrame, lexicon: DataFrame, categories: Sequence[str], key: str = "doc_id"
) -> DataFrame:
    """One count column per declared category; documents without hits drop out.

    Categories travel as numbers.  Hits are counted per document and category in
    each partition first, so what moves is a few small numbers per document; they
    are then folded into one map per document, from which the columns are read.
    """
    index = {c: i for i, c in enumerate(categories)}
    names = F.create_map(*[x for c, i in index.items() for x in (F.lit(c), F.lit(i))])
    table = lookup_table(
        lexicon.where(F.col("category").isin(*categories))
        .select("token", F.element_at(names, F.col("category")).alias("_c"))
        .distinct()
    )
    hits = tokens.select(key, "token").join(table, "token").groupBy(key, "_c").agg(F.count("*").alias("_n"))
    folded = hits.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_c", "_n"))).alias("_m"))
    return folded.select(
        key, *[F.coalesce(F.try_element_at("_m", F.lit(i)), F.lit(0)).alias(c) for c, i in index.items()]
    )


def lexicon_scores(
    df: DataFrame, lexicon: DataFrame, categories: Sequence[str], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Category hits over the token count, one column per category."""
    sized = df.select(key, F.size(X.tokenize(text)).alias("_n"), F.array_join(X.tokenize(F.lower(F.col(text))), " ").alias("_low"))
    hits = in_row_hits(sized, F.col("_low"), lexicon, categories, key)
    return hits.select(key, *[safe_div(F.get("_hits", F.lit(i)), F.col("_n")).alias(c) for i, c in enumerate(categories)])


def in_row_hits(
    df: DataFrame, tokens: Column, lexicon: DataFrame, categories: Sequence[str], key: str = "doc_id"
) -> DataFrame:
    """``df`` with an array ``_hits`` of counts in the order of ``categories``.

    ``tokens`` is a text of tokens joined by single blanks.  A lexicon within the
    bounds of ``small_rows`` is counted inside each row; a larger one by a join
    of the exploded tokens, with the same result: rows are numbered for it, so
    repeated and null keys keep their own counts.
    """
    index = {c: i for i, c in enumerate(categories)}
    known = F.col("category").isin(*categories) & (F.col("token") != "")
    table = written(lexicon.where(known).select("token", "category").distinct(), "lexicon")
    rows = small_rows(table)
    if rows is None:
        numbered = written(df.withColumn("_nr", F.monotonically_increasing_id()), "rows")
        exploded = numbered.select("_nr", F.explode(F.split(tokens, " ")).alias("token"))
        counts = lexicon_counts(exploded, table, categories, "_nr")
        counts = counts.select("_nr", F.array(*[F.col(c) for c in categories]).alias("_found"))
        none = F.array_repeat(F.lit(0).cast("bigint"), len(categories))
        return numbered.join(counts, "_nr", "left").withColumn("_hits", F.coalesce("_found", none)).select(*df.columns, "_hits")
    named: dict[str, list[int]] = {}
    for r in rows:
        named.setdefault(r["token"], []).append(index[r["category"]])
    return df.withColumn("_hits", token_hits(tokens, named, len(categories)))


def lexicon_map(hits: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``lexicon_hits`` folded into one map for each of ``documents``; empty without a hit."""
    folded = hits.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("category", "hits"))).alias("lexicon"))
    none = F.create_map().cast("map<string,bigint>")
    return documents.select(key).join(folded, key, "left").select(key, F.coalesce("lexicon", none).alias("lexicon"))


def unfamiliar_words(tokens: DataFrame, familiar: DataFrame, key: str = "doc_id") -> DataFrame:
    """Word counts of the tokens missing from the familiar list."""
    known = lookup_table(familiar.select("token").distinct())
    return (
        tokens.where(F.col("token").rlike(X.WORD))
        .select(key, F.lower("token").alias("token"))
        .join(known, "token", "left_anti")
        .groupBy(key, "token")
        .agg(F.count("*").alias("n"))
    )


def top_tokens(df: DataFrame, n: int, text: str = "text") -> DataFrame:
    """The ``n`` most frequent lower-cased words, ties alphabetical."""
    return (
        df.select(F.explode(X.words(F.lower(F.col(text)))).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("freq"))
        .orderBy(F.desc("freq"), "token")
        .limit(n)
    )


def build_vocab(
    df: DataFrame, size: int, text: str = "text", specials: Sequence[str] = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")
) -> DataFrame:
    """``(token, token_id)``: special tokens first, then by frequency, then alphabetical.

    Only the ``size`` kept tokens reach the numbering window.
    """
    tokens = (
        df.select(F.explode(X.tokenize(F.lower(F.col(text)))).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("freq"))
        .orderBy(F.desc("freq"), "token")
        .limit(size)
    )
    numbered = tokens.select(
        "token",
        (F.row_number().over(Window.orderBy(F.desc("freq"), "token")) - 1 + len(specials)).alias("token_id"),
    )
    head = df.sparkSession.createDataFrame(list(zip(specials, range(len(specials)))), "token string, token_id int")
    return head.unionByName(numbered)


def encode_tokens(
    df: DataFrame, vocab: DataFrame, max_length: int = 128, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Token ids and attention mask, truncated and padded to ``max_length``.

    Ids of the special tokens are those of ``build_vocab``: pad 0, unknown 1,
    start 2, end 3.  A text is cut to ``max_length - 2`` tokens; ``truncated``
    says whether it had more.  A vocabulary within the bounds of ``small_rows`` is
    looked up inside the row, a larger one by a join of numbered rows, with the same
    result for repeated and null keys.  Of a token listed twice the smaller id counts.
    """
    room = max_length - 2
    toks = df.select(key, X.tokenize(F.lower(F.col(text))).alias("_all")).select(
        key, F.slice("_all", 1, room).alias("toks"), (F.size("_all") > room).alias("truncated")
    )
    table = written(vocab.where("token is not null").groupBy("token").agg(F.min("token_id").alias("token_id")), "vocab")
    rows = small_rows(table)
    if rows is not None:
        number = token_numbers(F.array_join("toks", " "), {r["token"]: r["token_id"] for r in rows}, 1)
        ids = toks.select(key, "truncated", number.alias("body"))
    else:
        numbered = written(toks.withColumn("_nr", F.monotonically_increasing_id()), "rows")
        exploded = numbered.select("_nr", key, "truncated", F.posexplode_outer("toks").alias("pos", "token"))
        pair = F.when(F.col("token").isNotNull(), F.struct("pos", F.coalesce("token_id", F.lit(1)).cast("int").alias("id")))
        ids = exploded.join(table, "token", "left").groupBy("_nr", key, "truncated").agg(F.sort_array(F.collect_list(pair)).alias("p"))
        ids = ids.select(key, "truncated", F.col("p.id").alias("body"))
    return framed_ids(ids, max_length, key)


def framed_ids(ids: DataFrame, max_length: int, key: str) -> DataFrame:
    """Ids of ``body`` between start and end, padded to ``max_length``, with the mask of what is not padding."""
    body = F.concat(F.array(F.lit(2)), "body", F.array(F.lit(3)))
    pad = F.lit(max_length) - F.size("body") - 2
    return ids.select(
        key,
        F.concat(body, F.array_repeat(F.lit(0), pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("body") + 2), F.array_repeat(F.lit(0), pad)).alias("attention_mask"),
        "truncated",
    )


def token_bigrams(tagged: DataFrame, key: str = "doc_id") -> DataFrame:
    """Consecutive (word, tag) pairs inside a sentence of ``key, sent_id, pos, token, tag``."""
    w = Window.partitionBy(key, "sent_id").orderBy("pos")
    nxt = F.lead(F.struct("token", "tag")).over(w)
    return (
        tagged.withColumn("_next", nxt)
        .where(F.col("_next").isNotNull())
        .select(
            key, "sent_id", "pos", "token", "tag",
            F.col("_next.token").alias("next_token"),
            F.col("_next.tag").alias("next_tag"),
        )
    )


def sentence_bigrams(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same from sentence rows with ``token`` and ``tag`` arrays: no window, no shuffle."""
    n = F.greatest(F.size("token") - 1, F.lit(0))
    pairs = F.arrays_zip(
        F.slice("token", 1, n).alias("token"), F.slice("tag", 1, n).alias("tag"),
        F.slice("token", F.lit(2), n).alias("next_token"), F.slice("tag", F.lit(2), n).alias("next_tag"),
    )
    return sents.select(key, "sent_id", F.posexplode(pairs).alias("p", "b")).select(
        key, "sent_id", (F.col("p") + 1).alias("pos"), "b.*"
    )


def semantic_density(df: DataFrame, tags: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Share of meaning-bearing tags among the lower-cased word-or-mark tokens.

    With a tag table the tokens are exploded and joined; without one the suffix
    rules run on the token array inside the row.
    """
    low = F.lower(F.col(text))
    if tags is None:
        return df.select(key, X.density_of(X.tokenize(low)).alias("semantic_density"))
    rows = df.select(key, F.explode_outer(X.tokenize(low)).alias("token"))
    kept = X.is_word_or_punct(F.col("token"))
    return tag_tokens(rows, tags).groupBy(key).agg(
        F.coalesce(
            F.avg(F.when(kept, F.col("tag").isin(*X.MEANING_TAGS).cast("double"))), F.lit(0.0)
        ).alias("semantic_density")
    )
