"""Line-first quality rules: lines are judged, failures removed, then documents that lose too much."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .op8_order_minhash import occurrences
from .words import SPACE, Words, covered, mix, slices, U

SYMBOLS = "#*$%&|<>"
#: A short line without one of these at its end reads like a label.
TERMINAL = (".", "!", "?", "…", '"', "'", "”", "»", ")", ":", ";", "。")
SEPARATORS = ("|", "»", "›", "•", "·", ">")
BOILERPLATE = (
    "all rights reserved|cookie policy|uses cookies|accept cookies|privacy policy|terms of (use|service)|"
    "enable javascript|lorem ipsum|sign (in|up) (to|for)|log in to|click here|read more|subscribe (to|now)|"
    "share (on|this)|skip to content|powered by|back to top"
)
#: Percent of a line's word characters that may be symbols.
SYMBOL_PERCENT = 5
#: Words a line has at least to need no terminal mark.
LABEL_WORDS = 4
#: Words a line may have to be boilerplate by a phrase.
PHRASE_WORDS = 20
#: Percent of a document's word characters that must be left.
KEEP_PERCENT = 70
LEAST_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_lines_removed long, chars_kept long, clean_text string"
)


def sums_at(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def byte_table(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in chars]] = True
    return table


SYMBOL_BYTES, MARK_BYTES = byte_table(SYMBOLS), byte_table("!?")


def failing_lines(lines: pa.Array, words: Words, word_chars: np.ndarray) -> np.ndarray:
    """Lines that a rule removes; lines without a word never fail."""
    n = words.counts
    symbols = sums_at(SYMBOL_BYTES[words.data], words.offsets)
    marks = sums_at(MARK_BYTES[words.data], words.offsets)
    punctuation = (100 * symbols > SYMBOL_PERCENT * word_chars) | ((n >= 5) & (3 * marks > n))
    ends = np.zeros(len(n), dtype=bool)
    short = np.flatnonzero((n > 0) & (n < LABEL_WORDS))
    for i in short.tolist():
        last = words.begin[i + 1] - 1
        ends[i] = words.data[words.start[last] : words.end[last]].tobytes().decode("utf-8", "replace").endswith(TERMINAL)
    label = (n < LABEL_WORDS) & ~ends
    separators = sum(pc.count_substring(lines, s).to_numpy(zero_copy_only=False).astype(np.int64) for s in SEPARATORS)
    navigation = (separators >= 2) & (4 * separators >= n)
    phrase = pc.match_substring_regex(lines, BOILERPLATE, ignore_case=True).to_numpy(zero_copy_only=False)
    return (n > 0) & (punctuation | label | navigation | (phrase & (n <= PHRASE_WORDS)))


def judge(texts: pa.Array) -> pa.StructArray:
    """All columns of ``RESULT`` of each text; null is empty."""
    texts = texts.cast(pa.string()).fill_null("")
    words = Words(texts)
    docs = words.docs
    # words in windows of five found twice or more in their text
    hashes, same = words.windows(REPEAT_WINDOW)
    place = np.flatnonzero(same)
    key = hashes[place] ^ mix(words.doc[place].astype(U) + U(1))
    at = np.argsort(key, kind="stable")
    equal = key[at][1:] == key[at][:-1]
    twice = np.zeros(len(place), dtype=bool)
    twice[at] = np.concatenate([[False], equal]) | np.concatenate([equal, [False]]) if len(place) else False
    repeat = np.bincount(words.doc[covered(place[twice], REPEAT_WINDOW, len(words))], minlength=docs)
    # lines
    split = pc.split_pattern(texts, "\n")
    lines = split.flatten()
    of = np.repeat(np.arange(docs), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    by_line = Words(lines)
    code_point = ((by_line.data & 0xC0) != 0x80) & ~SPACE[by_line.data]
    chars = sums_at(code_point, by_line.offsets)
    with_word = np.flatnonzero(by_line.counts > 0)
    hashed = line_hashes(by_line)[with_word] ^ mix(of[with_word].astype(U) + U(1))
    repeated = np.bincount(of[with_word][occurrences(hashed) > 0], minlength=docs)
    failed = failing_lines(lines, by_line, chars)
    word_chars = np.bincount(of, weights=chars, minlength=docs).astype(np.int64)
    left = np.bincount(of, weights=np.where(failed, 0, chars), minlength=docs).astype(np.int64)
    base_failed = (words.counts < LEAST_WORDS) | (100 * repeat > REPEAT_PERCENT * words.counts)
    kept = ~base_failed & (100 * left >= KEEP_PERCENT * word_chars)
    removed = np.bincount(of[failed], minlength=docs)
    clean = texts.to_pylist()
    if removed.any():
        begin = split.offsets.to_numpy() - split.offsets[0].as_py()
        for i in np.flatnonzero(removed).tolist():
            lo, hi = int(begin[i]), int(begin[i + 1])
            clean[i] = "\n".join(lines.slice(lo, hi - lo).filter(pa.array(~failed[lo:hi])).to_pylist())
    symbols = sums_at(SYMBOL_BYTES[words.data], words.offsets)
    columns = [words.counts, word_chars, symbols, repeated, repeat]
    columns = [pa.array(np.asarray(c, dtype=np.int64)) for c in columns]
    columns += [pa.array(base_failed), pa.array(kept), pa.array(removed.astype(np.int64)), pa.array(left), pa.array(clean, pa.string())]
    return pa.StructArray.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])


def line_hashes(lines: Words) -> np.ndarray:
    """A hash of all bytes of each line, white space included."""
    data = lines.data.astype(U)
    place = np.arange(len(data), dtype=U) - np.repeat(lines.offsets[:-1], np.diff(lines.offsets)).astype(U)
    total = np.concatenate([[U(0)], np.cumsum(mix(data + (place << U(8))), dtype=U)])
    return mix(total[lines.offsets[1:]] - total[lines.offsets[:-1]] + np.diff(lines.offsets).astype(U))


def judge_column(texts: pa.Array) -> pa.Array:
    parts = [judge(part.column("text")) for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text")]
    return pa.concat_arrays(parts) if parts else judge(pa.array([], pa.string()))


def clean_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``quality`` of counts, verdicts and the cleaned text.

    A line fails if over 5 % of its word characters are symbols, if more than a
    third of its words carry ! or ?, if it has under four words and no terminal
    mark, if separators stand at every fourth word or closer, or if it is short
    and holds a boilerplate phrase.  A document is kept unless it has under 10
    words, over 20 % repeated words, or under 70 % of its word characters in lines
    that pass.  A null, empty or blank text has counts 0 and fails; whole texts
    are read; equal rows get equal results; an empty table gives no rows; a column
    named ``quality`` is replaced.
    """

    def call(texts: pa.Array) -> pa.Array:
        return judge_column(texts)

    return docs.withColumn("quality", F.arrow_udf(call, RESULT).asNondeterministic()(F.col(f"`{text_col}`")))


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


LINES_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs))
), counted AS (
  SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
    length(regexp_replace(line, '[^!?]', '', 'g')) AS marks,
    list_sum(list_transform({_sql_list(SEPARATORS)}, lambda s: len(string_split(line, s)) - 1)) AS separators,
    len(list_filter({_sql_list(TERMINAL)}, lambda t: ends_with(regexp_replace(line, '[\x20\x09-\x0D]+$', ''), t))) > 0 AS ends,
    regexp_matches(line, '{BOILERPLATE}', 'i') AS phrase,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS seen
  FROM lines
), judged AS (
  SELECT *, n > 0 AND (100 * symbols > {SYMBOL_PERCENT} * chars OR (n >= 5 AND 3 * marks > n) OR (n < {LABEL_WORDS} AND NOT ends)
    OR (separators >= 2 AND 4 * separators >= n) OR (phrase AND n <= {PHRASE_WORDS})) AS failed FROM counted
), by_doc AS (
  SELECT doc_id, sum(chars) AS word_chars, sum(CASE WHEN failed THEN 0 ELSE chars END) AS chars_kept,
    count(*) FILTER (n > 0 AND seen) AS n_dup_lines, count(*) FILTER (failed) AS n_lines_removed FROM judged GROUP BY doc_id
), flat AS (
  SELECT d.doc_id, len(d.w) AS n_words, b.word_chars, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    b.n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, b.n_lines_removed, b.chars_kept
  FROM words d JOIN by_doc b USING (doc_id) LEFT JOIN repeats r USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed,
  (n_words >= {LEAST_WORDS} AND 100 * n_repeat_words <= {REPEAT_PERCENT} * n_words AND 100 * chars_kept >= {KEEP_PERCENT} * word_chars) AS kept,
  CAST(n_lines_removed AS BIGINT) AS n_lines_removed, CAST(chars_kept AS BIGINT) AS chars_kept
FROM flat
"""


@base.query("op6_line_rules", LINES_SQL)
def op6_line_rules(spark, sf_dir: str) -> DataFrame:
    """Line rules over every whole text."""
    out = clean_lines(base.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        *[f"quality.{c}" for c in "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_lines_removed chars_kept".split()],
    )
