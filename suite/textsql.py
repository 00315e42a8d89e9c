"""SQL for cleaning and token measures, built from the same patterns."""

from __future__ import annotations

from inkgauge.fixed import EMOJI_RANGES, MEANING_TAGS
from inkgauge.functions.text import MARKDOWN_RULES, SPACE, TOKEN, VOWELS, WORD


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(expr: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(replacement.replace('$', chr(92)))}, 'g')"


def markdown(e: str) -> str:
    for _trigger, rules in MARKDOWN_RULES:
        for pattern, replacement in rules:
            e = sub(e, pattern, replacement)
    return sub(e, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def newlines(e: str) -> str:
    return sub(e, r"[\r\n]+", " ")


def spaces(e: str) -> str:
    return f"trim({sub(e, f'[{SPACE}]+', ' ')})"


def task(e: str) -> str:
    return sub(e, rf"^(?:Task(?:[{SPACE}]*\p{{Nd}}+)?\.?[{SPACE}]*)?", "")


def upper_tokens(e: str) -> str:
    return sub(e, r"[A-Z]+_[A-Z]+", "")


def punctuation(e: str) -> str:
    return sub(e, rf"[^\p{{L}}\p{{N}}_{SPACE}.?!,]", "")


def emoji(e: str) -> str:
    ranges = "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in EMOJI_RANGES)
    return sub(sub(e, r"\n+", " "), f"[{ranges}]+", "")


def tokens(e: str) -> str:
    return f"regexp_extract_all({e}, {lit(TOKEN)})"


def words(e: str) -> str:
    return f"regexp_extract_all({e}, {lit(WORD + '+')})"


def join_lemmas(e: str) -> str:
    """Token by token: the final s of words longer than three goes."""
    one = "CASE WHEN length(t) > 3 AND right(t, 1) = 's' THEN left(t, length(t) - 1) ELSE t END"
    return f"coalesce(array_to_string(list_transform({tokens(e)}, lambda t: {one}), ' '), '')"


def clean(e: str, order: str = "batch") -> str:
    e = task(spaces(newlines(markdown(e))))
    e = punctuation(upper_tokens(e)) if order == "serving" else upper_tokens(punctuation(e))
    return join_lemmas(e)


def sentences(e: str) -> str:
    marked = f"regexp_replace({e}, {lit(rf'([.?!])[{SPACE}]+')}, '\\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: length(trim(s)) > 0)"


def syllables(w: str) -> str:
    return f"greatest(1, len(regexp_extract_all(lower({w}), '[{VOWELS}]+')))"


def lemma(t: str) -> str:
    return (
        f"CASE WHEN length(lower({t})) > 3 AND right(lower({t}), 1) = 's' "
        f"THEN left(lower({t}), length(lower({t})) - 1) ELSE lower({t}) END"
    )


def tag(t: str) -> str:
    low = f"lower({t})"
    return (
        f"CASE WHEN NOT regexp_matches({t}, {lit(WORD)}) THEN {t} "
        f"WHEN {low} LIKE '%ly' THEN 'RB' WHEN {low} LIKE '%ing' THEN 'VBG' WHEN {low} LIKE '%ed' THEN 'VBD' "
        f"WHEN regexp_matches({low}, '(tion|ment|ness)$') THEN 'NN' "
        f"WHEN regexp_matches({low}, '(able|ous|ful)$') THEN 'JJ' "
        f"WHEN length({low}) <= 3 THEN 'DT' ELSE 'NN' END"
    )


def kept(t: str) -> str:
    return f"regexp_matches({t}, {lit(r'^(?:' + chr(92) + r'p{L}+|[!-/:-@' + chr(92) + r'[-`{-~])$')})"


MEANING = "(" + ", ".join(lit(t) for t in MEANING_TAGS) + ")"

CLEAN = f"clean AS (SELECT doc_id, {clean('text')} AS t FROM documents)"
SENTS = f"""sents AS (
  SELECT doc_id, unnest({sentences('t')}) AS s, generate_subscripts({sentences('t')}, 1) AS sent_id FROM clean)"""
TOKS = f"""toks AS (
  SELECT doc_id, sent_id, unnest({tokens('s')}) AS token, generate_subscripts({tokens('s')}, 1) AS pos FROM sents)"""

# Annotated tokens: fields of the rule annotator.
ANNOT = f"""tagged AS (
  SELECT doc_id, sent_id, pos, token, {lemma('token')} AS lemma, {tag('token')} AS tag,
    CAST(floor(pos / 2.0) AS INT) AS head,
    CASE WHEN pos > 1 AND regexp_matches(token, '^\\p{{Lu}}') THEN pos END AS ent_id
  FROM toks),
flagged AS (
  SELECT *, tag IN ('NN', 'JJ') AS inside,
    lag(tag IN ('NN', 'JJ')) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS before FROM tagged),
annot AS (
  SELECT doc_id, sent_id, pos, token, lemma, tag, head, ent_id, CASE WHEN inside THEN run END AS chunk_id FROM (
    SELECT *, sum(CASE WHEN before IS NULL OR before <> inside THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id, sent_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM flagged))"""

# Sentence trees by recursion over heads: depth, path and size limits.
TREES = """sizes AS (SELECT doc_id, sent_id, count(*) AS n FROM annot GROUP BY ALL HAVING count(*) >= 2),
nodes AS (SELECT a.doc_id, a.sent_id, a.pos, a.head, a.token FROM annot a JOIN sizes USING (doc_id, sent_id)),
walk AS (
  SELECT doc_id, sent_id, pos, token, 0 AS depth, lpad(CAST(pos AS VARCHAR), 6, '0') AS path FROM nodes WHERE head = 0
  UNION ALL
  SELECT n.doc_id, n.sent_id, n.pos, n.token, w.depth + 1, w.path || lpad(CAST(n.pos AS VARCHAR), 6, '0')
  FROM walk w JOIN nodes n ON n.doc_id = w.doc_id AND n.sent_id = w.sent_id AND n.head = w.pos),
kids AS (SELECT doc_id, sent_id, head AS pos, count(*) AS n_kids, min(pos) AS first_kid FROM nodes WHERE head > 0 GROUP BY ALL),
spine AS (
  SELECT doc_id, sent_id, pos, 0 AS len FROM nodes WHERE head = 0
  UNION ALL
  SELECT k.doc_id, k.sent_id, k.first_kid, s.len + 1
  FROM spine s JOIN kids k ON k.doc_id = s.doc_id AND k.sent_id = s.sent_id AND k.pos = s.pos),
shape AS (
  SELECT w.doc_id, w.sent_id, max(w.depth) AS depth, count(*) AS nodes,
    count(*) FILTER (WHERE k.pos IS NULL) AS leaves, max(CASE WHEN w.depth = 0 THEN k.n_kids END) AS branching
  FROM walk w LEFT JOIN kids k ON k.doc_id = w.doc_id AND k.sent_id = w.sent_id AND k.pos = w.pos GROUP BY ALL),
spines AS (SELECT doc_id, sent_id, max(len) AS spine FROM spine GROUP BY ALL),
trees AS (
  SELECT doc_id, max(depth) AS max_depth, avg(branching) AS avg_branching_factor, sum(nodes) AS total_nodes,
    sum(leaves) AS total_leaves, sum(nodes)::DOUBLE / sum(leaves) AS tree_complexity,
    stddev_pop(depth) AS depth_variability, stddev_pop(spine) AS tree_height_variability, avg(depth) AS mean_tree_height
  FROM shape JOIN spines USING (doc_id, sent_id) GROUP BY doc_id),
rule_counts AS (
  SELECT w.doc_id, w.token AS rule, count(*) AS n, min(lpad(CAST(w.sent_id AS VARCHAR), 9, '0') || w.path) AS first_at
  FROM walk w JOIN kids k ON k.doc_id = w.doc_id AND k.sent_id = w.sent_id AND k.pos = w.pos GROUP BY ALL),
rules AS (
  SELECT doc_id, count(*) AS unique_rules, max(rule) FILTER (WHERE rn = 1) AS most_common_rule FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) AS rn FROM rule_counts) GROUP BY doc_id)"""

COUNTS = f"""counts AS (
  SELECT doc_id, t, len({words('t')}) AS n_words, len({sentences('t')}) AS n_sentences,
    length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS n_letters,
    length({sub('t', f'[{SPACE}]+', '')}) AS n_characters,
    coalesce(list_sum(list_transform({words('t')}, lambda w: {syllables('w')})), 0) AS n_syllables,
    len(list_filter({words('t')}, lambda w: {syllables('w')} >= 3)) AS n_polysyllables
  FROM clean)"""

ENTROPY = """chars AS (SELECT doc_id, unnest(string_split(t, '')) AS c FROM clean),
char_counts AS (SELECT doc_id, c, count(*) AS n FROM chars WHERE c <> '' GROUP BY ALL),
entropy AS (
  SELECT doc_id, -sum(p * log2(p)) AS textual_entropy FROM (
    SELECT doc_id, n::DOUBLE / sum(n) OVER (PARTITION BY doc_id) AS p FROM char_counts) GROUP BY doc_id)"""

DENSITY = f"""density AS (
  SELECT doc_id, avg(CASE WHEN {tag('token')} IN {MEANING} THEN 1.0::DOUBLE ELSE 0.0 END) AS semantic_density FROM (
    SELECT doc_id, unnest({tokens('lower(t)')}) AS token FROM clean) WHERE {kept('token')} GROUP BY doc_id)"""


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END)"


FORMULAS = {
    "flesch_kincaid_grade": f"0.39::DOUBLE * {ratio('n_words', 'n_sentences')} + 11.8::DOUBLE * {ratio('n_syllables', 'n_words')} - 15.59::DOUBLE",
    "gunning_fog": f"0.4::DOUBLE * ({ratio('n_words', 'n_sentences')} + 100 * {ratio('n_polysyllables', 'n_words')})",
    "coleman_liau_index": f"0.0588::DOUBLE * (100 * {ratio('n_letters', 'n_words')}) - 0.296::DOUBLE * (100 * {ratio('n_sentences', 'n_words')}) - 15.8::DOUBLE",
    "smog_index": f"1.043::DOUBLE * sqrt({ratio('n_polysyllables * 30', 'n_sentences')}) + 3.1291::DOUBLE",
    "ari": f"4.71::DOUBLE * {ratio('n_characters', 'n_words')} + 0.5::DOUBLE * {ratio('n_words', 'n_sentences')} - 21.43::DOUBLE",
}
PCT = f"(100 * {ratio('n_difficult', 'n_words')})"
DALE = (
    f"0.1579::DOUBLE * {PCT} + 0.0496::DOUBLE * {ratio('n_words', 'n_sentences')} "
    f"+ CASE WHEN {PCT} > 5 THEN 3.6365::DOUBLE ELSE 0.0 END"
)

# The 200 most frequent lower-cased words.
FAMILIAR = f"""familiar AS (
  SELECT token FROM (SELECT unnest({words('lower(text)')}) AS token FROM documents) GROUP BY token
  ORDER BY count(*) DESC, token LIMIT 200)"""


def r6(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0::DOUBLE AS {name}"
