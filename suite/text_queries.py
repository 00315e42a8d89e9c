"""Text functions, tokens, annotation and features (X, T, W1, W2, V1, V2, J8, J9)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from inkgauge.fixed import EXTRA_TREE_FEATURES, FEATURES, LEXICON_CATEGORIES, READABILITY_FEATURES, TREE_FEATURES
from inkgauge.functions import readability as R
from inkgauge.functions import text as X
from inkgauge.operators import annotate as A
from inkgauge.operators import flow, lemmas as LE, parsing as PA, subwords as SW, tokens as K
from inkgauge.plans.feature_table import (
    FEATURE_GROUPS, cleaned, feature_breakdown, feature_projection, feature_table,
)
from inkgauge.session import spread, written

from . import textsql as S
from inkgauge.functions.base import draw

from .base import big, draw_sql, query, r6, table


def docs(spark, sf):
    """The texts, spread over the cores when the file is a single split."""
    return spread(table(spark, sf, "documents", "doc_id", "text"), "doc_id")


def clean_docs(spark, sf):
    return cleaned(docs(spark, sf)).withColumnRenamed("clean", "text")


# Categories of a token: two draws over the declared list, equal or not.
def lexicon(spark, sf):
    """``(category, token)`` from the words of the benchmark texts; most words are in two categories."""
    tok = table(spark, sf, "benchmark", "text").select(
        F.explode(X.words(F.lower("text"))).alias("token")
    ).distinct()
    names = F.array(*[F.lit(c) for c in LEXICON_CATEGORIES])

    def drawn(first: int):
        at = F.conv(F.substring(F.md5("token"), first, 8), 16, 10).cast("bigint") % len(LEXICON_CATEGORIES)
        return F.get(names, at.cast("int"))

    return tok.select(F.explode(F.array_distinct(F.array(drawn(1), drawn(9)))).alias("category"), "token")


NAMES = "[" + ", ".join(S.lit(c) for c in LEXICON_CATEGORIES) + "]"
def lexicon_sql(form: str = "token") -> str:
    """The lexicon, its words in the given form."""
    return f"""lexicon AS (
  SELECT DISTINCT {form} AS token, {NAMES}[1 + ('0x' || substr(md5(token), first, 8))::BIGINT % {len(LEXICON_CATEGORIES)}] AS category
  FROM (SELECT unnest({S.words('lower(text)')}) AS token FROM benchmark), (VALUES (1), (9)) AS v(first))"""


LEXICON = lexicon_sql()
# In the feature table the words of both tables have the form the cleaned text has.
LEXICON_FORMS = lexicon_sql(S.lemma("token"))
FAMILIAR_FORMS = S.FAMILIAR.replace("familiar AS (", "raw_familiar AS (", 1) + f", familiar AS (SELECT DISTINCT {S.lemma('token')} AS token FROM raw_familiar)"


def familiar(spark, sf):
    return K.top_tokens(docs(spark, sf), 200).select("token")


LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ_"


# -- scalar text functions --------------------------------------------------

def _text_function(name, spark_fn, sql_fn, tbl="documents", key="doc_id", text="text"):
    @query(name, f"SELECT {key}, {sql_fn(text)} AS out FROM {tbl}")
    def run(spark, sf):
        return spread(table(spark, sf, tbl, key, text), key).select(key, spark_fn(F.col(text)).alias("out"))


_text_function("x1_newlines_to_space", X.newlines_to_space, S.newlines)
_text_function("x2_collapse_whitespace", X.collapse_whitespace, S.spaces)
_text_function("x3_strip_task_prefix", lambda c: X.strip_task_prefix(F.concat(F.lit("Task 3. "), c)), lambda e: S.task(f"('Task 3. ' || {e})"))
_text_function("x4_drop_upper_tokens", lambda c: X.drop_upper_tokens(F.translate(c, LOWER, UPPER)), lambda e: S.upper_tokens(f"translate({e}, '{LOWER}', '{UPPER}')"))
_text_function("x5_strip_punctuation", X.strip_punctuation, S.punctuation)
_text_function("x6_strip_emoji", X.strip_emoji, S.emoji)
_text_function("x7_markdown_to_text", X.markdown_to_text, S.markdown, "pages", "page_id", "html")
_text_function("x8_lower", F.lower, lambda e: f"lower({e})")
_text_function("x9_tokenize", lambda c: F.array_join(X.tokenize(c), " "), lambda e: f"coalesce(array_to_string({S.tokens(e)}, ' '), '')")
_text_function("x10_lemmatize", lambda c: X.join_tokens(X.lemmatize_text(c)), S.join_lemmas)
_text_function("x11_sentences", lambda c: F.array_join(X.sentences(c), "|"), lambda e: f"coalesce(array_to_string({S.sentences(e)}, '|'), '')")
_text_function(
    "x12_is_word_or_punct",
    lambda c: F.size(F.filter(X.tokenize(c), X.is_word_or_punct)).cast("bigint"),
    lambda e: f"len(list_filter({S.tokens(e)}, lambda t: {S.kept('t')}))",
)
_text_function("x13_clean_text", X.clean_text, S.clean)
_text_function("x14_clean_text_serving", lambda c: X.clean_text(c, order="serving"), lambda e: S.clean(e, "serving"))
_text_function(
    "x21_tagged_text",
    lambda c: X.tagged_text(X.tokenize(c), F.transform(X.tokenize(c), lambda t: X.suffix_tag(t))),
    lambda e: f"coalesce(array_to_string(list_transform({S.tokens(e)}, lambda t: t || '/' || {S.tag('t')}), ' '), '')",
)


# -- text features ----------------------------------------------------------

COUNT_COLS = X.COUNTS


def counted(spark, sf):
    c = clean_docs(spark, sf)
    return c.select("doc_id", "text", X.text_counts("text").alias("c")).select("doc_id", "text", "c.*")


@query("t1_text_counts", f"WITH {S.CLEAN}, {S.COUNTS} SELECT doc_id, " + ", ".join(f"{c}::BIGINT AS {c}" for c in COUNT_COLS) + " FROM counts")
def t1(spark, sf):
    return counted(spark, sf).select("doc_id", *[big(c) for c in COUNT_COLS])


def _score(name, fn):
    col = name.split("_", 1)[1]

    @query(name, f"WITH {S.CLEAN}, {S.COUNTS} SELECT doc_id, {S.r6(S.FORMULAS[col], col)} FROM counts")
    def run(spark, sf):
        return counted(spark, sf).select("doc_id", r6(fn(), col))


_score("t2_flesch_kincaid_grade", lambda: R.flesch_kincaid_grade(F.col("n_words"), F.col("n_sentences"), F.col("n_syllables")))
_score("t3_gunning_fog", lambda: R.gunning_fog(F.col("n_words"), F.col("n_sentences"), F.col("n_polysyllables")))
_score("t4_coleman_liau_index", lambda: R.coleman_liau_index(F.col("n_words"), F.col("n_sentences"), F.col("n_letters")))
_score("t5_smog_index", lambda: R.smog_index(F.col("n_sentences"), F.col("n_polysyllables")))
_score("t6_ari", lambda: R.ari(F.col("n_words"), F.col("n_sentences"), F.col("n_characters")))

DIFFICULT = f"""difficult AS (
  SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest({S.words('lower(t)')}) AS token FROM clean)
  WHERE token NOT IN (SELECT token FROM familiar) GROUP BY doc_id),
judged AS (SELECT c.*, coalesce(d.n, 0) AS n_difficult FROM counts c LEFT JOIN difficult d USING (doc_id))"""


@query("t7_dale_chall", f"WITH {S.CLEAN}, {S.COUNTS}, {S.FAMILIAR}, {DIFFICULT} SELECT doc_id, {S.r6(S.DALE, 'dale_chall')} FROM judged")
def t7(spark, sf):
    base = counted(spark, sf)
    hard = (
        K.unfamiliar_words(K.token_rows(base.select("doc_id", "text")), familiar(spark, sf))
        .groupBy("doc_id")
        .agg(F.sum("n").alias("n_difficult"))
    )
    joined = base.join(hard, "doc_id", "left")
    score = R.dale_chall(F.col("n_words"), F.col("n_sentences"), F.coalesce("n_difficult", F.lit(0)))
    return joined.select("doc_id", r6(score, "dale_chall"))


@query(
    "t8_semantic_density",
    f"WITH {S.CLEAN}, {S.DENSITY} SELECT c.doc_id, {S.r6('coalesce(semantic_density, 0.0)', 'semantic_density')} FROM clean c LEFT JOIN density USING (doc_id)",
)
def t8(spark, sf):
    return K.semantic_density(clean_docs(spark, sf)).select("doc_id", r6("semantic_density"))


@query(
    "t8b_semantic_density_tag_table",
    f"""WITH {S.CLEAN}, {S.FAMILIAR}, all_t AS (SELECT doc_id, unnest({S.tokens('lower(t)')}) AS token FROM clean),
density AS (SELECT doc_id, avg(CASE WHEN token IN (SELECT token FROM familiar) THEN 0.0::DOUBLE
  WHEN {S.tag('token')} IN {S.MEANING} THEN 1.0 ELSE 0.0 END) AS semantic_density FROM all_t WHERE {S.kept('token')} GROUP BY doc_id)
SELECT c.doc_id, {S.r6('coalesce(semantic_density, 0.0)', 'semantic_density')} FROM clean c LEFT JOIN density USING (doc_id)""",
)
def t8b(spark, sf):
    tags = familiar(spark, sf).withColumn("tag", F.lit("DT"))
    return K.semantic_density(clean_docs(spark, sf), tags).select("doc_id", r6("semantic_density"))


@query(
    "t9_text_tagged",
    f"""WITH {S.CLEAN} SELECT doc_id, coalesce(array_to_string(list_transform(list_filter({S.tokens('lower(t)')}, lambda t: {S.kept('t')}),
  lambda t: t || '/' || {S.tag('t')}), ' '), '') AS text_tagged FROM clean""",
)
def t9(spark, sf):
    return clean_docs(spark, sf).select("doc_id", X.tagged_of(X.tokenize(F.lower("text"))).alias("text_tagged"))


@query(
    "t10_semantic_flow_variability",
    """WITH v AS (SELECT vec_id // 5 AS doc_id, vec_id AS sent_id, embedding AS a,
  lead(embedding) OVER (PARTITION BY vec_id // 5 ORDER BY vec_id) AS b FROM embeddings)
SELECT doc_id, round(coalesce(stddev_pop(CASE WHEN b IS NOT NULL THEN list_dot_product(a::DOUBLE[], b::DOUBLE[]) /
  (sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[])) * sqrt(list_dot_product(b::DOUBLE[], b::DOUBLE[]))) END), 0.0), 6) AS semantic_flow_variability
FROM v GROUP BY doc_id""",
)
def t10(spark, sf):
    vecs = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("doc_id"), F.col("vec_id").alias("sent_id"), "embedding")
    return flow.semantic_flow_variability(vecs).select("doc_id", r6("semantic_flow_variability"))


SLOTS = "list_transform(range(32), lambda d: len(list_filter({toks}, lambda t: ('0x' || substr(md5(lower(t)), 1, 8))::BIGINT % 32 = d))::DOUBLE)"


ORACLE_FLOW = f"""WITH {S.CLEAN}, {S.SENTS},
vec AS (SELECT doc_id, sent_id, {SLOTS.format(toks=S.tokens('s'))} AS a FROM sents),
pairs AS (SELECT doc_id, a, lead(a) OVER (PARTITION BY doc_id ORDER BY sent_id) AS b FROM vec)
SELECT doc_id, round(coalesce(stddev_pop(CASE WHEN b IS NOT NULL THEN list_dot_product(a, b) /
  (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) END), 0.0), 6) AS semantic_flow_variability FROM pairs GROUP BY doc_id"""


@query("t10b_hashed_sentence_flow", ORACLE_FLOW)
def t10b(spark, sf):
    vecs = flow.sentence_vectors(clean_docs(spark, sf))
    return flow.semantic_flow_variability(vecs).select("doc_id", r6("semantic_flow_variability"))


@query("t10c_text_flow", ORACLE_FLOW)
def t10c(spark, sf):
    return clean_docs(spark, sf).select("doc_id", r6(flow.text_flow("text"), "semantic_flow_variability"))


@query(
    "w1_consecutive_similarity",
    """WITH v AS (SELECT vec_id // 5 AS doc_id, vec_id AS sent_id, embedding::DOUBLE[] AS a,
  lead(embedding::DOUBLE[]) OVER (PARTITION BY vec_id // 5 ORDER BY vec_id) AS b FROM embeddings)
SELECT doc_id, sent_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS similarity
FROM v WHERE b IS NOT NULL""",
)
def w1(spark, sf):
    vecs = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("doc_id"), F.col("vec_id").alias("sent_id"), "embedding")
    return flow.consecutive_similarity(vecs).select("doc_id", "sent_id", r6("similarity"))


@query(
    "w2_token_bigrams",
    f"""WITH {S.CLEAN}, {S.SENTS}, {S.TOKS}, pairs AS (
  SELECT token, {S.tag('token')} AS tag, lead(token) OVER w AS next_token, lead({S.tag('token')}) OVER w AS next_tag FROM toks
  WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY pos))
SELECT token, tag, next_token, next_tag, count(*) AS n FROM pairs WHERE next_token IS NOT NULL GROUP BY ALL""",
)
def w2(spark, sf):
    pairs = K.sentence_bigrams(A.annotate_sentences(clean_docs(spark, sf)))
    return pairs.groupBy("token", "tag", "next_token", "next_tag").agg(F.count("*").alias("n"))


@query(
    "w2b_token_bigram_rows",
    f"""WITH {S.CLEAN}, {S.SENTS}, {S.TOKS} SELECT doc_id, sent_id, pos, token, lead(token) OVER w AS next_token FROM toks
  WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY pos) QUALIFY lead(token) OVER w IS NOT NULL""",
)
def w2b(spark, sf):
    tagged = A.annotate(clean_docs(spark, sf)).select("doc_id", "sent_id", "pos", "token", "tag")
    return K.token_bigrams(tagged).select("doc_id", "sent_id", "pos", "token", "next_token")


@query(
    "j8_lexicon_join",
    f"""WITH {S.CLEAN}, {LEXICON}, all_t AS (SELECT doc_id, unnest({S.words('lower(t)')}) AS token FROM clean)
SELECT doc_id, category, count(*) AS hits FROM all_t JOIN lexicon USING (token) GROUP BY ALL""",
)
def j8(spark, sf):
    return K.lexicon_hits(K.token_rows(clean_docs(spark, sf)), lexicon(spark, sf))


@query(
    "j9_unfamiliar_words",
    f"""WITH {S.CLEAN}, {S.FAMILIAR}, all_t AS (SELECT doc_id, unnest({S.words('lower(t)')}) AS token FROM clean)
SELECT doc_id, token, count(*) AS n FROM all_t WHERE token NOT IN (SELECT token FROM familiar) GROUP BY ALL""",
)
def j9(spark, sf):
    return K.unfamiliar_words(K.token_rows(clean_docs(spark, sf)), familiar(spark, sf))


PIVOT = ", ".join(
    f"round(coalesce(sum(hits) FILTER (WHERE category = {S.lit(c)}), 0)::DOUBLE / greatest(any_value(n_tok), 1), 6) AS \"{c}\""
    for c in LEXICON_CATEGORIES
)
HITS = f"""all_w AS (SELECT doc_id, unnest({S.words('lower(t)')}) AS token FROM clean),
hits AS (SELECT doc_id, category, count(*) AS hits FROM all_w JOIN lexicon USING (token) GROUP BY ALL),
per_doc AS (SELECT c.doc_id, len({S.tokens('t')}) AS n_tok, h.category, h.hits FROM clean c LEFT JOIN hits h USING (doc_id)),
lex AS (SELECT doc_id, {PIVOT} FROM per_doc GROUP BY doc_id)"""


@query("t11_lexicon_scores", f"WITH {S.CLEAN}, {LEXICON}, {HITS} SELECT * FROM lex")
def t11(spark, sf):
    out = K.lexicon_scores(clean_docs(spark, sf), lexicon(spark, sf), LEXICON_CATEGORIES)
    return out.select("doc_id", *[r6(c) for c in LEXICON_CATEGORIES])


@query(
    "t11b_lexicon_map",
    f"""WITH {S.CLEAN}, {LEXICON}, all_t AS (SELECT doc_id, unnest({S.words('lower(t)')}) AS token FROM clean),
h AS (SELECT doc_id, category, count(*) AS hits FROM all_t JOIN lexicon USING (token) GROUP BY ALL)
SELECT c.doc_id, count(category) AS categories, coalesce(sum(hits), 0)::BIGINT AS hits, max(hits) FILTER (WHERE category = 'help') AS help
FROM clean c LEFT JOIN h USING (doc_id) GROUP BY c.doc_id""",
)
def t11b(spark, sf):
    base = clean_docs(spark, sf)
    m = K.lexicon_map(K.lexicon_hits(K.token_rows(base), lexicon(spark, sf)), base)
    total = F.aggregate(F.map_values("lexicon"), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return m.select("doc_id", big(F.size("lexicon"), "categories"), total.alias("hits"), F.try_element_at("lexicon", F.lit("help")).alias("help"))


@query(
    "t12_textual_entropy",
    f"WITH {S.CLEAN}, {S.ENTROPY} SELECT c.doc_id, {S.r6('coalesce(textual_entropy, 0.0)', 'textual_entropy')} FROM clean c LEFT JOIN entropy USING (doc_id)",
)
def t12(spark, sf):
    return clean_docs(spark, sf).select("doc_id", r6(X.textual_entropy("text"), "textual_entropy"))


BASE = f"{S.CLEAN}, {S.SENTS}, {S.TOKS}, {S.ANNOT}"

TOKEN_STATS = """tstats AS (
  SELECT doc_id, count(DISTINCT sent_id) AS num_sentences, count(*) AS num_tokens, count(DISTINCT lemma) AS num_unique_lemmas,
    sum(length(token))::DOUBLE / count(*) AS average_token_length, count(*)::DOUBLE / count(DISTINCT sent_id) AS average_sentence_length,
    count(DISTINCT tag) AS num_pos_tags FROM annot GROUP BY doc_id)"""
ENTITY_STATS = """estats AS (
  SELECT doc_id, count(*) FILTER (WHERE ent_id IS NOT NULL) AS num_entities,
    count(DISTINCT CASE WHEN ent_id IS NOT NULL THEN token END) AS num_distinct_entities,
    coalesce(avg(CASE WHEN ent_id IS NOT NULL THEN length(token) END), 0.0) AS average_entity_length FROM annot GROUP BY doc_id)"""
CHUNK_STATS = """chunks AS (
  SELECT doc_id, sent_id, chunk_id, length(string_agg(token, ' ' ORDER BY pos)) AS chars FROM annot WHERE chunk_id IS NOT NULL GROUP BY ALL),
cstats AS (
  SELECT d.doc_id, count(chars) AS num_noun_chunks, coalesce(avg(chars), 0.0) AS average_noun_chunk_length
  FROM (SELECT DISTINCT doc_id FROM annot) d LEFT JOIN chunks USING (doc_id) GROUP BY d.doc_id)"""


@query(
    "t13_token_stats",
    f"""WITH {BASE}, {TOKEN_STATS} SELECT doc_id, num_sentences, num_tokens, num_unique_lemmas,
  {S.r6('average_token_length', 'average_token_length')}, {S.r6('average_sentence_length', 'average_sentence_length')}, num_pos_tags FROM tstats""",
)
def t13(spark, sf):
    out = A.token_stats(A.annotate(clean_docs(spark, sf)))
    return out.select(
        "doc_id", "num_sentences", "num_tokens", "num_unique_lemmas", r6("average_token_length"), r6("average_sentence_length"), "num_pos_tags"
    )


@query(
    "t14_entity_stats",
    f"WITH {BASE}, {ENTITY_STATS} SELECT doc_id, num_entities, num_distinct_entities, {S.r6('average_entity_length', 'average_entity_length')} FROM estats",
)
def t14(spark, sf):
    return A.entity_stats(A.annotate(clean_docs(spark, sf))).select(
        "doc_id", "num_entities", "num_distinct_entities", r6("average_entity_length")
    )


@query(
    "t15_noun_chunk_stats",
    f"WITH {BASE}, {CHUNK_STATS} SELECT doc_id, num_noun_chunks, {S.r6('average_noun_chunk_length', 'average_noun_chunk_length')} FROM cstats",
)
def t15(spark, sf):
    return A.noun_chunk_stats(A.annotate(clean_docs(spark, sf))).select("doc_id", "num_noun_chunks", r6("average_noun_chunk_length"))


RECURSIVE = f"WITH RECURSIVE {BASE}, {S.TREES}"
TREE_ROWS = "(SELECT DISTINCT doc_id FROM annot) d LEFT JOIN trees t ON t.doc_id = d.doc_id"


@query(
    "t16_tree_depth",
    f"""{RECURSIVE} SELECT d.doc_id, coalesce(max_depth, 0)::BIGINT AS max_depth,
  round(coalesce(depth_variability, 'NaN'::DOUBLE), 6) AS depth_variability FROM {TREE_ROWS}""",
)
def t16(spark, sf):
    return A.tree_stats(A.annotate_sentences(clean_docs(spark, sf))).select("doc_id", "max_depth", r6("depth_variability"))


@query(
    "t17_branching",
    f"""{RECURSIVE} SELECT d.doc_id, round(coalesce(avg_branching_factor, 0.0), 6) AS avg_branching_factor, coalesce(total_nodes, 0)::BIGINT AS total_nodes,
  coalesce(total_leaves, 0)::BIGINT AS total_leaves, round(coalesce(tree_complexity, 0.0), 6) AS tree_complexity FROM {TREE_ROWS}""",
)
def t17(spark, sf):
    return A.tree_stats(A.annotate_sentences(clean_docs(spark, sf))).select(
        "doc_id", r6("avg_branching_factor"), big("total_nodes"), big("total_leaves"), r6("tree_complexity")
    )


@query(
    "t18_rules",
    f"""{RECURSIVE} SELECT d.doc_id, coalesce(unique_rules, 0) AS unique_rules, most_common_rule
FROM (SELECT DISTINCT doc_id FROM annot) d LEFT JOIN rules USING (doc_id)""",
)
def t18(spark, sf):
    return A.rule_stats(A.annotate_sentences(clean_docs(spark, sf)))


@query(
    "t19_tree_height_variability",
    f"""{RECURSIVE} SELECT d.doc_id, round(coalesce(tree_height_variability, 'NaN'::DOUBLE), 6) AS tree_height_variability FROM {TREE_ROWS}""",
)
def t19(spark, sf):
    return A.tree_stats(A.annotate_sentences(clean_docs(spark, sf))).select("doc_id", r6("tree_height_variability"))


@query("t20_pos_distribution", f"WITH {BASE} SELECT doc_id, tag, count(*) AS n FROM annot GROUP BY ALL")
def t20(spark, sf):
    return A.pos_distribution(A.annotate(clean_docs(spark, sf)))


@query(
    "t20b_tree_helpers",
    f"""{RECURSIVE}, lab AS (SELECT n.doc_id, count(k.pos) FILTER (WHERE n.token = 'the') AS label_count
  FROM nodes n LEFT JOIN kids k ON k.doc_id = n.doc_id AND k.sent_id = n.sent_id AND k.pos = n.pos GROUP BY n.doc_id),
phr AS (SELECT doc_id, avg(leaves) AS average_phrase_length FROM shape GROUP BY doc_id)
SELECT c.doc_id, coalesce(label_count, 0) AS label_count, round(coalesce(average_phrase_length, 0.0), 6) AS average_phrase_length,
  round(coalesce(mean_tree_height, 0.0), 6) AS mean_tree_height
FROM clean c LEFT JOIN trees t USING (doc_id) LEFT JOIN lab USING (doc_id) LEFT JOIN phr USING (doc_id)""",
)
def t20b(spark, sf):
    base = clean_docs(spark, sf)
    sents = A.written_trees(A.annotate_sentences(base))
    stats = A.tree_stats(sents).select("doc_id", "mean_tree_height")
    out = base.select("doc_id")
    for part in (A.label_counts(sents, "the"), A.phrase_lengths(sents), stats):
        out = out.join(part, "doc_id", "left")
    zero = F.lit(0)
    return out.select(
        "doc_id", F.coalesce("label_count", zero).alias("label_count"),
        r6(F.coalesce("average_phrase_length", zero), "average_phrase_length"), r6(F.coalesce("mean_tree_height", zero), "mean_tree_height"),
    )


@query(
    "t21_annotate",
    f"WITH {BASE} SELECT doc_id, sent_id, pos, token, lemma, tag, head, ent_id, chunk_id::INT AS chunk_id FROM annot",
)
def t21(spark, sf):
    return A.annotate(clean_docs(spark, sf))


# The rule annotation is the annotated table here; counts of pairs are raised by 0.1, those of a word by 0.1 shared out.
TAGGER = """known AS MATERIALIZED (SELECT doc_id, sent_id, pos, lower(token) AS word, tag FROM annot),
tags AS MATERIALIZED (SELECT DISTINCT tag FROM known),
pairs AS (SELECT coalesce(p.tag, '<s>') AS a, k.tag AS b, count(*) AS n FROM known k LEFT JOIN known p ON p.doc_id = k.doc_id AND p.sent_id = k.sent_id AND p.pos = k.pos - 1 GROUP BY ALL),
smooth AS (SELECT a.tag AS a, b.tag AS b, 0.1::DOUBLE + coalesce(n, 0) AS n FROM (SELECT tag FROM tags UNION ALL SELECT '<s>') a JOIN tags b ON true LEFT JOIN pairs p ON p.a = a.tag AND p.b = b.tag),
step AS MATERIALIZED (SELECT a, b, ln(n / sum(n) OVER (PARTITION BY a)) AS p FROM smooth),
share AS MATERIALIZED (SELECT b AS tag, sum(n) AS n FROM smooth GROUP BY b),
top AS (SELECT word, count(*) AS n FROM known GROUP BY word ORDER BY n DESC, word LIMIT 50000),
ends AS (SELECT right(word, 3) AS word, count(*) AS n FROM known GROUP BY ALL ORDER BY n DESC, word LIMIT 50000),
by_word AS (SELECT word, tag, count(*) AS n FROM known GROUP BY ALL),
by_end AS (SELECT right(word, 3) AS word, tag, count(*) AS n FROM known GROUP BY ALL),
emit AS MATERIALIZED (SELECT w.word, s.tag, CASE WHEN t.word IS NOT NULL THEN ln((0.1::DOUBLE * s.n / total + coalesce(bw.n, 0)) / s.n)
    WHEN e.word IS NOT NULL THEN ln((0.1::DOUBLE * s.n / total + coalesce(be.n, 0)) / s.n) ELSE ln(s.n / total) END AS p
  FROM (SELECT DISTINCT word FROM known) w JOIN (SELECT *, sum(n) OVER () AS total FROM share) s ON true LEFT JOIN top t ON t.word = w.word LEFT JOIN ends e ON e.word = right(w.word, 3)
  LEFT JOIN by_word bw ON bw.word = w.word AND bw.tag = s.tag LEFT JOIN by_end be ON be.word = right(w.word, 3) AND be.tag = s.tag),
search AS (
  SELECT doc_id, sent_id, 1::BIGINT AS pos, e.tag, s.p + e.p AS score, NULL::VARCHAR AS came FROM known k JOIN emit e USING (word) JOIN step s ON s.a = '<s>' AND s.b = e.tag WHERE pos = 1
  UNION ALL
  SELECT v.doc_id, v.sent_id, v.pos + 1, s.b, max(v.score + s.p) + any_value(e.p), arg_max(v.tag, v.score + s.p)
  FROM search v JOIN known k ON k.doc_id = v.doc_id AND k.sent_id = v.sent_id AND k.pos = v.pos + 1 JOIN step s ON s.a = v.tag JOIN emit e ON e.word = k.word AND e.tag = s.b
  GROUP BY v.doc_id, v.sent_id, v.pos, s.b),
last AS (SELECT doc_id, sent_id, max(pos) AS pos FROM known GROUP BY ALL),
back AS (
  SELECT l.doc_id, l.sent_id, l.pos, arg_max(s.tag, s.score) AS tag, arg_max(coalesce(s.came, ''), s.score) AS came FROM last l JOIN search s USING (doc_id, sent_id, pos) GROUP BY ALL
  UNION ALL SELECT b.doc_id, b.sent_id, s.pos, s.tag, coalesce(s.came, '') FROM back b JOIN search s ON s.doc_id = b.doc_id AND s.sent_id = b.sent_id AND s.pos = b.pos - 1 AND s.tag = b.came)"""


def fitted_parses(spark, sf):
    """Tags and heads decoded by models that are fitted to the rule annotation."""
    clean = spread(written(clean_docs(spark, sf), "clean"), "doc_id")
    rules = A.annotate(clean, fields=("token", "tag", "head"))
    return PA.parse_sentences(clean, PA.fit_tagger(rules), PA.fit_arcs(rules))


@query("t21b_decoded_tags", f"WITH RECURSIVE {BASE}, {TAGGER} SELECT doc_id, sent_id, pos, tag FROM back")
def t21b(spark, sf):
    clean = spread(written(clean_docs(spark, sf), "clean"), "doc_id")
    tagger = PA.fit_tagger(A.annotate(clean, fields=("token", "tag")))
    none = PA.Arcs(tagger.tags, np.zeros((len(tagger.tags), len(tagger.tags), 2)), np.zeros(len(tagger.tags)))
    return A.explode_annotations(PA.parse_sentences(clean, tagger, none), fields=("token", "tag")).select("doc_id", "sent_id", big("pos"), "tag")


@query("t21c_parsed_trees")
def t21c(spark, sf):
    """Tree and token measures of decoded parses; every tree depends on its sentence's tags."""
    sents = written(fitted_parses(spark, sf), "parses")
    trees = A.tree_stats(sents).select("doc_id", "max_depth", r6("avg_branching_factor"), "total_nodes", r6("mean_tree_height"))
    chunks = A.noun_chunk_stats(A.explode_annotations(sents, fields=("token", "chunk_id"))).select("doc_id", "num_noun_chunks")
    return trees.join(chunks, "doc_id")


# Pairs of token and lemma: the noun-suffix rule, and "ing" and "ed" off longer words.  A fifth of the tokens is held out.
PAIRS = f"""pairs AS (SELECT token AS t, CASE WHEN length(token) > 5 AND token LIKE '%ing' THEN left(token, length(token) - 3)
    WHEN length(token) > 4 AND token LIKE '%ed' THEN left(token, length(token) - 2) || 'e'
    WHEN length(token) > 3 AND right(token, 1) = 's' THEN left(token, length(token) - 1) ELSE token END AS l,
    {draw_sql('token', 3)} < 0.2 AS held
  FROM (SELECT DISTINCT unnest({S.tokens('lower(text)')}) AS token FROM documents) WHERE regexp_matches(token, '^[a-z]+$'))"""
ENDINGS_SQL = """kept AS (SELECT t, l, coalesce(list_position(list_transform(range(1, least(length(t), length(l)) + 1), lambda i: t[i] = l[i]), false) - 1, least(length(t), length(l))) AS k FROM pairs WHERE NOT held),
rules AS (SELECT t, (length(t) - k)::INT AS cut, substr(l, k + 1) AS put FROM kept WHERE length(t) - k <= 6),
votes AS (SELECT right(t, n) AS ending, cut, put, count(*) AS votes FROM (SELECT *, unnest(range(cut, least(6, length(t)) + 1)) AS n FROM rules) GROUP BY ALL),
endings AS (SELECT ending, cut, put, votes FROM (SELECT *, row_number() OVER (PARTITION BY ending ORDER BY votes DESC, cut, put) AS rn, sum(votes) OVER (PARTITION BY ending) AS every FROM votes) WHERE rn = 1 AND every >= 2)"""


def lemma_pairs(spark, sf):
    t = F.col("token")
    tokens = docs(spark, sf).select(F.explode(X.tokenize(F.lower("text"))).alias("token")).distinct().where(t.rlike("^[a-z]+$"))
    lemma = F.when((F.length(t) > 5) & t.endswith("ing"), F.left(t, F.length(t) - 3)).when((F.length(t) > 4) & t.endswith("ed"), F.concat(F.left(t, F.length(t) - 2), F.lit("e")))
    return tokens.select("token", F.coalesce(lemma, X.lemma(t)).alias("lemma"), (draw("token", 3) < 0.2).alias("held"))


@query("x10b_learned_endings", f"WITH {PAIRS}, {ENDINGS_SQL} SELECT * FROM endings")
def x10b(spark, sf):
    return LE.learn_endings(lemma_pairs(spark, sf).where("not held"))


@query(
    "x10c_held_out_lemmas",
    f"""WITH {PAIRS}, {ENDINGS_SQL},
best AS (SELECT p.t, arg_max({{'cut': e.cut, 'put': e.put}}, length(e.ending)) AS r FROM pairs p JOIN endings e ON length(e.ending) <= length(p.t) AND right(p.t, length(e.ending)) = e.ending
  WHERE held AND e.cut <= length(p.t) GROUP BY p.t)
SELECT p.t AS token, coalesce(left(p.t, length(p.t) - r.cut) || r.put, CASE WHEN length(p.t) > 3 AND right(p.t, 1) = 's' THEN left(p.t, length(p.t) - 1) ELSE p.t END) AS lemma,
  p.l AS expected FROM pairs p LEFT JOIN best USING (t) WHERE held""",
)
def x10c(spark, sf):
    """Lemmas of held-out tokens by endings learned from the others."""
    pairs = written(lemma_pairs(spark, sf), "pairs")
    endings = LE.learn_endings(pairs.where("not held"))
    found = LE.with_ending_lemmas(pairs.where("held").select("token", F.col("lemma").alias("expected")), endings)
    return found.select("token", "lemma", "expected")


# -- flagship ---------------------------------------------------------------

INTS = {
    "num_sentences", "num_tokens", "num_unique_lemmas", "num_entities", "num_noun_chunks", "num_pos_tags",
    "num_distinct_entities", "max_depth", "total_nodes", "total_leaves", "unique_rules",
}


def feature_output(df):
    out = feature_projection(df, ["doc_id", "most_common_rule", *FEATURES])
    return out.select(
        "doc_id", "most_common_rule", *[F.col(c) if c in INTS else r6(c) for c in dict.fromkeys(FEATURES)]
    )


def feature_sql(raw: bool = False) -> str:
    """The whole feature table; ``raw`` leaves the core features unrounded."""
    cols = []

    def out(expr: str, name: str) -> str:
        return f"CAST({expr} AS DOUBLE) AS {name}" if raw else S.r6(expr, name)

    for c in (*READABILITY_FEATURES, "textual_entropy", "semantic_density", *TREE_FEATURES, *EXTRA_TREE_FEATURES):
        if c in INTS:
            cols.append(f"coalesce({c}, 0)::BIGINT AS {c}")
        elif c in S.FORMULAS:
            cols.append(out(S.FORMULAS[c].replace("n_sentences", "j.n_sentences"), c))
        elif c == "dale_chall":
            cols.append(out(S.DALE, c))
        elif c in ("depth_variability", "tree_height_variability"):
            cols.append(f"round(coalesce({c}, 'NaN'::DOUBLE), 6) AS {c}")
        else:
            cols.append(out(f"coalesce({c}, 0.0)", c))
    return f"""{RECURSIVE}, {S.COUNTS}, {FAMILIAR_FORMS}, {DIFFICULT}, {S.ENTROPY}, {S.DENSITY}, {LEXICON_FORMS}, {HITS},
{TOKEN_STATS}, {ENTITY_STATS}, {CHUNK_STATS}
SELECT j.doc_id, most_common_rule, {', '.join(cols)}, lex.* EXCLUDE (doc_id)
FROM judged j LEFT JOIN entropy USING (doc_id) LEFT JOIN density USING (doc_id) LEFT JOIN tstats USING (doc_id)
LEFT JOIN estats USING (doc_id) LEFT JOIN cstats USING (doc_id) LEFT JOIN trees USING (doc_id) LEFT JOIN rules USING (doc_id)
LEFT JOIN lex USING (doc_id)"""


@query("t22_feature_table", feature_sql())
def t22(spark, sf):
    return feature_output(feature_table(docs(spark, sf), lexicon(spark, sf), familiar(spark, sf)))


# Annotations of another kind than the rules give: trees that are no heaps, entities of several tokens.
OTHER_ANNOT = S.ANNOT.replace("\nannot AS (", "\nrule_annot AS (", 1) + """,
annot AS (SELECT doc_id, sent_id, pos, token, lemma, tag, CASE WHEN pos = 1 THEN 0 WHEN pos % 3 = 0 THEN 1 ELSE pos - 1 END::INT AS head,
  CASE WHEN ent_id IS NOT NULL THEN pos // 2 END AS ent_id, chunk_id FROM rule_annot)"""
OTHER_ENTITIES = """spans AS (SELECT doc_id, sent_id, ent_id, string_agg(token, ' ' ORDER BY pos) AS span FROM annot WHERE ent_id IS NOT NULL GROUP BY ALL),
estats AS (
  SELECT d.doc_id, count(span) AS num_entities, count(DISTINCT span) AS num_distinct_entities, coalesce(avg(length(span)), 0.0) AS average_entity_length
  FROM (SELECT DISTINCT doc_id FROM annot) d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id)"""
OTHER_DENSITY = f"""density AS (SELECT doc_id, avg(CASE WHEN token IN (SELECT token FROM raw_familiar) THEN 0.0::DOUBLE
  WHEN {S.tag('token')} IN {S.MEANING} THEN 1.0 ELSE 0.0 END) AS semantic_density
  FROM (SELECT doc_id, unnest({S.tokens('lower(t)')}) AS token FROM clean) WHERE {S.kept('token')} GROUP BY doc_id)"""


def other_annotations(spark, sf):
    """Token rows with heads and spans of their own, as another annotator would give them."""
    rows = A.annotate(clean_docs(spark, sf))
    pos = F.col("pos")
    return rows.withColumn("head", F.when(pos == 1, 0).when(pos % 3 == 0, 1).otherwise(pos - 1).cast("int")).withColumn(
        "ent_id", F.when(F.col("ent_id").isNotNull(), F.floor(pos / 2)).cast("int")
    )


@query(
    "t22b_feature_table_annotated",
    feature_sql().replace(S.ANNOT, OTHER_ANNOT).replace(ENTITY_STATS, OTHER_ENTITIES).replace(S.DENSITY, OTHER_DENSITY),
)
def t22b(spark, sf):
    sents = A.collect_annotations(other_annotations(spark, sf))
    tags = familiar(spark, sf).withColumn("tag", F.lit("DT"))
    return feature_output(feature_table(docs(spark, sf), lexicon(spark, sf), familiar(spark, sf), annotations=sents, tags=tags))


GROUP_NAMES = " ".join(f"WHEN '{f}' THEN '{g}'" for f, g in FEATURE_GROUPS.items() if f not in LEXICON_CATEGORIES)


@query(
    "p12b_feature_breakdown",
    f"""WITH f AS ({feature_sql()}), d AS (SELECT doc_id, CAST(COLUMNS(* EXCLUDE (doc_id, most_common_rule)) AS DOUBLE) FROM f),
u AS (UNPIVOT d ON COLUMNS(* EXCLUDE (doc_id)) INTO NAME feature VALUE value)
SELECT doc_id, CASE feature {GROUP_NAMES} ELSE 'Psycholinguistic Features' END AS "group", feature, value FROM u""",
)
def p12b(spark, sf):
    return feature_breakdown(t22(spark, sf))


# -- vocabulary and ids -----------------------------------------------------

VOCAB = f"""freq AS (SELECT token, count(*) AS n FROM (SELECT unnest({S.tokens('lower(text)')}) AS token FROM documents) GROUP BY token),
top AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id FROM freq ORDER BY n DESC, token LIMIT 2000),
vocab AS (SELECT token, token_id FROM top UNION ALL SELECT * FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3)))"""


@query("v2_build_vocab", f"WITH {VOCAB} SELECT token, token_id::INT AS token_id FROM vocab")
def v2(spark, sf):
    return K.build_vocab(docs(spark, sf), 2000)


@query(
    "v1_encode_tokens",
    f"""WITH {VOCAB}, cut AS (SELECT doc_id, unnest(list_slice({S.tokens('lower(text)')}, 1, 126)) AS token,
  generate_subscripts(list_slice({S.tokens('lower(text)')}, 1, 126), 1) AS pos FROM documents),
ids AS (SELECT c.doc_id, string_agg(coalesce(v.token_id, 1)::VARCHAR, ' ' ORDER BY c.pos) AS body, count(*) AS n
  FROM cut c LEFT JOIN vocab v USING (token) GROUP BY c.doc_id)
SELECT d.doc_id, '2 ' || coalesce(body || ' ', '') || '3' || repeat(' 0', 126 - coalesce(n, 0)::INT) AS input_ids,
  trim(repeat('1 ', coalesce(n, 0)::INT + 2) || repeat('0 ', 126 - coalesce(n, 0)::INT)) AS attention_mask
FROM documents d LEFT JOIN ids USING (doc_id)""",
)
def v1(spark, sf):
    enc = K.encode_tokens(docs(spark, sf), K.build_vocab(docs(spark, sf), 2000))
    return enc.select(
        "doc_id",
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), " ").alias("attention_mask"),
    )


# Pair merges one after another over the distinct words; a symbol stands between chr(2) and chr(3).
MERGES = 24


def _merge_steps() -> str:
    steps = []
    for k in range(1, MERGES + 1):
        steps.append(f"""best{k} AS MATERIALIZED (SELECT l, r, l || CASE WHEN starts_with(r, '##') THEN substr(r, 3) ELSE r END AS token FROM (
    SELECT unnest(s[:-2]) AS l, unnest(s[2:]) AS r, n FROM (SELECT string_split(substr(w, 2, length(w) - 2), chr(3) || chr(2)) AS s, n FROM words{k - 1}) WHERE len(s) > 1)
  GROUP BY l, r HAVING sum(n) >= 2 ORDER BY sum(n) DESC, l, r LIMIT 1),
words{k} AS MATERIALIZED (SELECT coalesce(replace(w, chr(2) || l || chr(3) || chr(2) || r || chr(3), chr(2) || token || chr(3)), w) AS w, n FROM words{k - 1} LEFT JOIN best{k} ON true)""")
    return ", ".join(steps)


SUBWORDS = f"""freq AS (SELECT token, count(*) AS n FROM (SELECT unnest({S.tokens('lower(text)')}) AS token FROM documents) GROUP BY token),
words0 AS MATERIALIZED (SELECT chr(2) || array_to_string(list_transform(string_split(token, ''), lambda c, i: CASE WHEN i = 1 THEN c ELSE '##' || c END), chr(3) || chr(2)) || chr(3) AS w, n
  FROM freq WHERE length(token) <= 100),
letters AS (SELECT DISTINCT unnest(string_split(substr(w, 2, length(w) - 2), chr(3) || chr(2))) AS token FROM words0),
{_merge_steps()},
listed AS (SELECT token, min(k) AS k FROM (
  SELECT token, row_number() OVER (ORDER BY token) AS k FROM letters
  {" ".join(f"UNION ALL SELECT token, {1_000_000 + k} FROM best{k}" for k in range(1, MERGES + 1))}) GROUP BY token),
vocab AS (SELECT token, (row_number() OVER (ORDER BY k) + 3)::INT AS token_id FROM listed
  UNION ALL SELECT * FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3)))"""


@query("v2b_subword_vocab", f"WITH {SUBWORDS} SELECT * FROM vocab")
def v2b(spark, sf):
    return SW.train_subwords(docs(spark, sf), merges=MERGES)


@query(
    "v1b_encode_subwords",
    f"""WITH RECURSIVE {SUBWORDS},
known AS (SELECT map_from_entries(list((token, token_id))) AS m, max(length(token)) AS most FROM vocab WHERE token_id > 3),
pieces AS (SELECT token AS word, token AS rest, '' AS head, '' AS ids FROM freq WHERE length(token) <= 100
  UNION ALL SELECT word, substr(rest, size + 1), '##', ids || ' ' || m[head || left(rest, size)] FROM (
    SELECT p.*, m, list_filter(range(least(most, length(rest)), 0, -1), lambda k: len(map_extract(m, head || left(rest, k))) > 0)[1] AS size FROM pieces p, known WHERE rest <> '')
  WHERE size IS NOT NULL),
numbers AS (SELECT f.token, coalesce(trim(p.ids), '1') AS ids FROM freq f LEFT JOIN pieces p ON p.word = f.token AND p.rest = ''),
cut AS (SELECT doc_id, unnest(list_slice({S.tokens('lower(text)')}, 1, 127)) AS token, generate_subscripts(list_slice({S.tokens('lower(text)')}, 1, 127), 1) AS pos FROM documents),
ids AS (SELECT doc_id, string_split(string_agg(ids, ' ' ORDER BY pos), ' ') AS every FROM cut JOIN numbers USING (token) GROUP BY doc_id),
framed AS (SELECT doc_id, coalesce(list_slice(every, 1, 126), []) AS body, coalesce(len(every), 0) > 126 AS truncated FROM documents LEFT JOIN ids USING (doc_id))
SELECT doc_id, '2 ' || coalesce(array_to_string(body, ' ') || ' ', '') || '3' || repeat(' 0', 126 - len(body)) AS input_ids, len(body) + 2 AS n_ids, truncated FROM framed""",
)
def v1b(spark, sf):
    enc = SW.encode_subwords(docs(spark, sf), SW.train_subwords(docs(spark, sf), merges=MERGES))
    ids = F.array_join(F.col("input_ids").cast("array<string>"), " ")
    return enc.select("doc_id", ids.alias("input_ids"), big(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x), "n_ids"), "truncated")
