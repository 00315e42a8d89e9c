"""Annotated sentences (tokens, lemmas, tags, heads, spans) and their measures.

Annotation is a table contract.  ``annotate_sentences`` is the rule annotator;
rows of any other annotator in the same token form enter through
``collect_annotations``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.base import let, safe_div
from ..functions.trees import preorder_key, tree_shape
from ..session import written
from .tokens import sentence_rows

TOKEN_FIELDS = ("token", "lemma", "tag", "head", "ent_id", "chunk_id")


def rule_heads(tokens: Column) -> Column:
    return F.transform(tokens, lambda _t, i: F.floor((i + 1) / 2).cast("int"))


def in_chunk(tag: Column) -> Column:
    return tag.isin("NN", "JJ")


def chunk_flags(tags: Column) -> Column:
    """One letter per token: ``N`` inside a noun chunk, ``.`` outside."""
    return F.array_join(F.transform(tags, lambda t: F.when(in_chunk(t), "N").otherwise(".")), "")


def rule_chunks(tags: Column) -> Column:
    """Run ordinal for tokens of a maximal NN/JJ run, null outside."""
    runs = F.regexp_extract_all(chunk_flags(tags), F.lit(r"N+|\.+"), F.lit(0))
    return F.flatten(
        F.transform(
            runs,
            lambda r, k: F.array_repeat(F.when(r.startswith("N"), k + 1).cast("int"), F.length(r)),
        )
    )


def rule_entities(tokens: Column) -> Column:
    """A capitalised token that does not open its sentence is an entity."""
    return F.transform(tokens, lambda t, i: F.when((i > 0) & t.rlike(r"^\p{Lu}"), i + 1).cast("int"))


def annotate_sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sentence with parallel arrays of the annotation fields."""
    toks = sentence_rows(df, key, text).select(key, "sent_id", X.tokenize("sentence").alias("token"))
    lowered = toks.withColumn("_low", F.transform("token", F.lower))
    tagged = lowered.withColumn("tag", F.zip_with("token", "_low", X.lowered_tag))
    return tagged.select(
        key,
        "sent_id",
        "token",
        F.transform("_low", lambda t: X.lemma(t, lowered=True)).alias("lemma"),
        "tag",
        rule_heads(F.col("token")).alias("head"),
        rule_entities(F.col("token")).alias("ent_id"),
        rule_chunks(F.col("tag")).alias("chunk_id"),
    )


def explode_annotations(sents: DataFrame, key: str = "doc_id", fields: Sequence[str] = TOKEN_FIELDS) -> DataFrame:
    """Sentence rows -> token rows ``key, sent_id, pos`` and the ``fields`` of a token; others are not made for it."""
    return sents.select(key, "sent_id", F.posexplode(F.arrays_zip(*fields)).alias("p", "t")).select(
        key, "sent_id", (F.col("p") + 1).alias("pos"), *[F.col(f"t.{f}").alias(f) for f in fields]
    )


def collect_annotations(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token rows -> sentence rows; a group is one sentence of one document."""
    rows = tokens.groupBy(key, "sent_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", *TOKEN_FIELDS))).alias("t")
    )
    return rows.select(key, "sent_id", *[F.col(f"t.{f}").alias(f) for f in TOKEN_FIELDS])


def annotate(df: DataFrame, key: str = "doc_id", text: str = "text", fields: Sequence[str] = TOKEN_FIELDS) -> DataFrame:
    return explode_annotations(annotate_sentences(df, key, text), key, fields)


# -- document measures over annotated token rows ----------------------------

def token_stats(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sentence, token, lemma and tag counts with mean lengths.

    Lemmas and tags are reduced per document before counting: the sets are
    bounded by one text.
    """
    return tokens.groupBy(key).agg(
        F.size(F.collect_set("sent_id")).cast("bigint").alias("num_sentences"),
        F.count("*").alias("num_tokens"),
        F.size(F.collect_set("lemma")).cast("bigint").alias("num_unique_lemmas"),
        safe_div(F.sum(F.length("token")), F.count("*")).alias("average_token_length"),
        safe_div(F.count("*"), F.size(F.collect_set("sent_id"))).alias("average_sentence_length"),
        F.size(F.collect_set("tag")).cast("bigint").alias("num_pos_tags"),
    )


def _span_rows(tokens: DataFrame, span: str, key: str) -> DataFrame:
    """One row per span with its blank-joined text; tokens outside spans give one null row per sentence."""
    inside = F.when(F.col(span).isNotNull(), F.struct("pos", "token"))
    return (
        tokens.groupBy(key, "sent_id", span)
        .agg(F.sort_array(F.collect_list(inside)).alias("t"))
        .select(key, F.when(F.col(span).isNotNull(), F.array_join(F.col("t.token"), " ")).alias("span"))
    )


def entity_stats(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    return _span_rows(tokens, "ent_id", key).groupBy(key).agg(
        F.count("span").alias("num_entities"),
        F.size(F.collect_set("span")).cast("bigint").alias("num_distinct_entities"),
        safe_div(F.coalesce(F.sum(F.length("span")), F.lit(0)), F.count("span")).alias("average_entity_length"),
    )


def noun_chunk_stats(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunk count and mean length in characters (blanks inside included)."""
    chars = F.when(F.col("chunk_id").isNotNull(), F.sum(F.length("token")) + F.count("*") - 1)
    parts = tokens.groupBy(key, "sent_id", "chunk_id").agg(chars.alias("chars"))
    return parts.groupBy(key).agg(
        F.count("chars").alias("num_noun_chunks"),
        safe_div(F.coalesce(F.sum("chars"), F.lit(0)), F.count("chars")).alias("average_noun_chunk_length"),
    )


def _sentence_trees(sents: DataFrame, key: str) -> DataFrame:
    """Shapes of the sentences, however long; null for one token.  Rows that have them already stay as they are."""
    if "shape" in sents.columns:
        return sents
    return sents.select(
        key, "sent_id", "token", "head",
        F.when(F.size("head") >= 2, tree_shape(F.col("head"))).alias("shape"),
    )


def written_trees(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sentences with their tree shapes, evaluated once for several measures of trees."""
    return written(_sentence_trees(sents, key), "trees")


def tree_stats(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Depth, branching, size and spread of a document's sentence trees, in one aggregate.

    A document without trees has zeros and a NaN spread.
    """
    nan, zero = F.lit(float("nan")), F.lit(0)
    nodes, leaves = (F.coalesce(F.sum(f"shape.{c}"), zero) for c in ("nodes", "leaves"))
    return _sentence_trees(sents, key).groupBy(key).agg(
        F.coalesce(F.max("shape.depth"), zero).cast("bigint").alias("max_depth"),
        F.coalesce(F.avg("shape.branching"), zero).alias("avg_branching_factor"),
        nodes.alias("total_nodes"),
        leaves.alias("total_leaves"),
        safe_div(nodes, leaves).alias("tree_complexity"),
        F.coalesce(F.stddev_pop("shape.depth"), nan).alias("depth_variability"),
        F.coalesce(F.stddev_pop("shape.spine"), nan).alias("tree_height_variability"),
        F.coalesce(F.avg("shape.depth"), zero).alias("mean_tree_height"),
    )


def rule_stats(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct surface forms of tokens with children, and the most common one.

    Ties go to the form met first in the pre-order walk of the trees.
    """
    heads = F.col("head").cast("array<int>")
    forms = _sentence_trees(sents, key).select(
        key,
        "sent_id",
        F.explode_outer(
            F.transform(
                "shape.internal",
                lambda n: F.struct(
                    F.get("token", n["pos"] - 1).alias("rule"), preorder_key(heads, n["pos"], n["depth"]).alias("path")
                ),
            )
        ).alias("r"),
    )
    counted = forms.groupBy(key, F.col("r.rule").alias("rule")).agg(
        F.count("*").alias("n"), F.min(F.struct("sent_id", "r.path")).alias("first")
    )
    ranked = F.when(F.col("rule").isNotNull(), F.struct((-F.col("n")).alias("neg"), "first", "rule"))
    return counted.groupBy(key).agg(
        F.count("rule").alias("unique_rules"), F.min(ranked)["rule"].alias("most_common_rule")
    )


def label_counts(sents: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """How many tokens with children carry the surface form ``label``; 0 without a tree."""
    n = F.size(F.filter("shape.internal", lambda p: F.get("token", p["pos"] - 1) == label))
    n = F.when(F.col("shape").isNotNull(), n).otherwise(0)
    return _sentence_trees(sents, key).groupBy(key).agg(F.sum(n).alias("label_count"))


def phrase_lengths(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mean number of childless tokens per tree; 0 without a tree."""
    mean = F.coalesce(F.avg("shape.leaves"), F.lit(0.0))
    return _sentence_trees(sents, key).groupBy(key).agg(mean.alias("average_phrase_length"))


def pos_distribution(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tag counts per document in tall form; ``pos_map`` folds them into a map."""
    return tokens.groupBy(key, "tag").agg(F.count("*").alias("n"))


def pos_map(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    return pos_distribution(tokens, key).groupBy(key).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag", "n")))).alias("pos_counts")
    )


# -- the same measures inside one document row ------------------------------

def syntax_struct(clean: Column) -> Column:
    """All token, entity, chunk and tree features of a cleaned text as one struct."""

    def per_sentence(toks: Column) -> Column:
        return F.when(F.size(toks) >= 2, tree_shape(rule_heads(toks)))

    def rules_of(toks: Column, shape: Column) -> Column:
        """Surface forms of the tokens with children."""
        forms = F.transform(shape["internal"], lambda n: F.get(toks, n["pos"] - 1))
        return F.when(shape.isNull(), F.array().cast("array<string>")).otherwise(forms)

    def spans(toks: Column) -> Column:
        return F.filter(toks, lambda t, i: (i > 0) & t.rlike(r"^\p{Lu}"))

    def body(st: Column) -> Column:
        low = F.transform(st, lambda s: F.transform(s, F.lower))
        return let(low, lambda lo: staged(st, lo))

    def staged(st: Column, lo: Column) -> Column:
        stage = F.struct(
            F.flatten(st).alias("tok"),
            F.flatten(lo).alias("low"),
            F.transform(lo, lambda s: F.transform(s, lambda t: X.suffix_tag(t, lowered=True))).alias("stag"),
            F.transform(st, per_sentence).alias("shape"),
            F.flatten(F.transform(st, spans)).alias("ents"),
        )
        return let(stage, lambda v: finish(st, v))

    def finish(st: Column, v: Column) -> Column:
        more = F.struct(
            F.filter(v["shape"], lambda s: s.isNotNull()).alias("trees"),
            F.zip_with(st, v["shape"], rules_of).alias("srules"),
            F.flatten(F.transform(v["stag"], lambda t: F.regexp_extract_all(chunk_flags(t), F.lit("N+"), F.lit(0)))).alias("chunks"),
            F.flatten(v["stag"]).alias("tag"),
        )
        return let(more, lambda m: let(F.flatten(m["srules"]), lambda rules: features(st, v, m, rules)))

    def total(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0).cast("bigint"), lambda a, b: a + b.cast("bigint"))

    def features(st: Column, v: Column, m: Column, rules: Column) -> Column:
        tok, trees = v["tok"], m["trees"]
        n_tok = F.size(tok).cast("bigint")
        n_sent = F.size(st).cast("bigint")
        n_ent = F.size(v["ents"]).cast("bigint")
        n_chunk = F.size(m["chunks"]).cast("bigint")
        inside = F.zip_with(tok, m["tag"], lambda t, g: F.when(in_chunk(g), F.length(t)).otherwise(0))
        chunk_chars = total(inside) + total(F.transform(m["chunks"], lambda c: F.length(c) - 1))
        nodes, leaves = total(trees["nodes"]), total(trees["leaves"])
        has_tree = F.size(trees) > 0
        return F.struct(
            n_sent.alias("num_sentences"),
            n_tok.alias("num_tokens"),
            F.size(F.array_distinct(F.transform(v["low"], lambda t: X.lemma(t, lowered=True)))).cast("bigint").alias("num_unique_lemmas"),
            safe_div(total(F.transform(tok, F.length)), n_tok).alias("average_token_length"),
            safe_div(n_tok, n_sent).alias("average_sentence_length"),
            n_ent.alias("num_entities"),
            n_chunk.alias("num_noun_chunks"),
            F.size(F.array_distinct(m["tag"])).cast("bigint").alias("num_pos_tags"),
            F.size(F.array_distinct(v["ents"])).cast("bigint").alias("num_distinct_entities"),
            safe_div(total(F.transform(v["ents"], F.length)), n_ent).alias("average_entity_length"),
            safe_div(chunk_chars, n_chunk).alias("average_noun_chunk_length"),
            F.coalesce(F.array_max(trees["depth"]), F.lit(0)).cast("bigint").alias("max_depth"),
            F.when(has_tree, total(trees["branching"]) / F.size(trees)).otherwise(0.0).alias("avg_branching_factor"),
            nodes.alias("total_nodes"),
            leaves.alias("total_leaves"),
            F.size(F.array_distinct(rules)).cast("bigint").alias("unique_rules"),
            most_common_rule(rules, m["srules"], st, v["shape"]).alias("most_common_rule"),
            safe_div(nodes, leaves).alias("tree_complexity"),
            trees["depth"].alias("_depths"),
            trees["spine"].alias("_spines"),
        )

    return let(F.transform(X.sentences(clean), X.tokenize), body)


def top_elements(items: Column) -> Column:
    """The most common elements of an array (several when counts tie), sorted.

    Equal elements are neighbours in the sorted copy, so counts are distances
    between the starts of neighbouring runs: linear after the sort.
    """

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(
            starts,
            lambda at: F.transform(
                at,
                lambda p, k: F.struct((F.coalesce(F.get(at, k + 1), n) - p).alias("n"), F.get(s, p).alias("x")),
            ),
        )

    def tied(r: Column) -> Column:
        return let(F.array_max(r["n"]), lambda top: F.transform(F.filter(r, lambda e: e["n"] == top), lambda e: e["x"]))

    found = let(F.sort_array(items), lambda s: let(runs(s), tied))
    return F.when(F.size(items) > 0, found).otherwise(F.array().cast("array<string>"))


def most_common_rule(rules: Column, srules: Column, st: Column, shapes: Column) -> Column:
    """Most common rule; a tie goes to the form met first in the pre-order walk.

    Only a tie needs the walk, and only in the first sentence that holds one of
    the tied forms.
    """

    def walk(top: Column, at: Column) -> Column:
        toks, shape = F.get(st, at), F.get(shapes, at)
        named = F.transform(
            shape["internal"], lambda n: F.struct(n["pos"].alias("pos"), n["depth"].alias("depth"), F.get(toks, n["pos"] - 1).alias("x"))
        )
        here = F.filter(named, lambda n: F.array_contains(top, n["x"]))
        keyed = let(
            rule_heads(toks),
            lambda h: F.transform(here, lambda n: F.struct(preorder_key(h, n["pos"], n["depth"]).alias("path"), n["x"].alias("x"))),
        )
        return F.array_min(keyed)["x"]

    def first_sentence(top: Column) -> Column:
        holds = F.transform(srules, lambda r: F.arrays_overlap(r, top))
        return (F.array_position(holds, True) - 1).cast("int")

    return let(
        top_elements(rules),
        lambda top: F.when(F.size(top) <= 1, F.get(top, F.lit(0))).otherwise(
            let(first_sentence(top), lambda at: walk(top, at))
        ),
    )
