"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols.  Words one edit apart have reduced words
that are equal or one edit apart, so each word generates the full one-edit
neighbourhood of its reduced word and meets the reduced vocabulary by an
equijoin; the words themselves decide.  A word's form is its most frequent
neighbour, if that is much more frequent, and its root the end of the forms.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base
from ..session import written
from .words import slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: One run of a document in so many loses a letter; words have at least so many letters and occurrences.
ONE_IN, LEAST_LENGTH, LEAST_COUNT = 199, 6, 5
#: A form is at least so many times as frequent as its word.
TIMES = 5
#: Numbers of symbols to choose from: the fewest for which few words share a reduced word.
SYMBOLS, SHARED = (4, 8, 16, 32, 64), 2.0
#: Words whose neighbourhoods a task generates, about.
PART_WORDS = 8_000
#: Different words a task counts before it passes them on, and characters of a text whose runs are held at once.
HELD_WORDS, HELD_CHARS = 200_000, 1_000_000


# -- words and their counts ----------------------------------------------------


def runs_of(text: str) -> Counter:
    """How often each run of letters is in a text."""
    if len(text) <= HELD_CHARS:
        return Counter(RUN.findall(text))
    return Counter(m.group() for m in RUN.finditer(text))


def word_batches(batches: Iterator[pa.RecordBatch], one_in: int, least: int) -> Iterator[pa.RecordBatch]:
    """``word, n`` of the words of the task, a word once or a few times."""
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for part in slices(batch, "text"):
            for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in runs_of(text or "").items():
                    run = run.translate(LOWER)
                    h = zlib.crc32(run.encode(), start)
                    if h % one_in == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= least:
                        counts[run] += n
                if len(counts) > HELD_WORDS:
                    yield out()
                    counts.clear()
    yield out()


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    one_in: int = ONE_IN, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
) -> DataFrame:
    """``word, n``: the words of all texts with their occurrences.

    A null text has no words; a null id is an empty string before the colon of the
    hash.  Rows count each, whether their ids or texts repeat or not.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = rows.mapInArrow(partial(word_batches, one_in=one_in, least=least_length), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# -- reduced words and their neighbourhoods --------------------------------------


def reduced(word: Column, letters: str, symbols: int) -> Column:
    """The word over ``symbols`` symbols: the letter of frequency rank r becomes symbol r mod ``symbols``."""
    return F.translate(word, letters, "".join(symbol(i % symbols) for i in range(len(letters))))


def symbol(i: int) -> str:
    return chr(ord("0") + i)


def neighbourhood(word: Column, symbols: int) -> Column:
    """All strings over the symbols that are equal to ``word`` or one edit from it, each once."""
    n = F.length(word)
    alphabet = F.array(*[F.lit(symbol(i)) for i in range(symbols)])
    before = lambda i: F.substring(word, F.lit(1), i)
    after = lambda i: F.substring(word, i + 1, n)
    gone = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(before(i - 1), after(i)))
    other = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(alphabet, lambda c: F.concat(before(i - 1), c, after(i)))))
    more = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(alphabet, lambda c: F.concat(before(i), c, after(i)))))
    return F.array_distinct(F.concat(gone, other, more))


def letters_by_frequency(words: DataFrame) -> str:
    """The letters of the vocabulary, the most frequent first: no more than the pattern of a run has."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count()
    return "".join(r.letter for r in letters.orderBy(F.desc("count"), "letter").collect())


def fewest_symbols(words: DataFrame, letters: str, choices: tuple[int, ...] = SYMBOLS, shared: float = SHARED) -> int:
    """The fewest symbols for which a word's reduced word stands for at most ``shared`` words on average.

    More words need more symbols; so a reduced word stands for few words at every
    size of the vocabulary, while a neighbourhood has about 2 * length * symbols words.
    """
    forms = F.array(*[F.struct(F.lit(s).alias("symbols"), reduced(F.col("word"), letters, s).alias("key")) for s in choices])
    sizes = words.select(F.explode(forms).alias("form")).groupBy("form.symbols", "form.key").agg(F.count("*").alias("size"))
    sums = sizes.groupBy("symbols").agg((F.sum(F.col("size") * F.col("size")) / F.sum("size")).alias("mean")).collect()
    return min((r.symbols for r in sums if r.mean <= shared), default=max(choices))


def near_words(words: DataFrame, letters: str, symbols: int) -> DataFrame:
    """``word, n, near, near_n`` of all pairs one edit apart, in both directions.

    The edit is checked inside the join, so it puts out near words alone.
    """
    own = reduced(F.col("word"), letters, symbols)
    # a neighbourhood is far larger than its word, so the words are dealt to many tasks
    spread = words.repartition(base.parts_for(words.count(), PART_WORDS), "word")
    probes = spread.select("word", "n", own.alias("own")).select("word", "n", F.explode(neighbourhood(F.col("own"), symbols)).alias("key"))
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), own.alias("near_key"))
    one_edit = (F.abs(F.length("word") - F.length("near")) <= 1) & (F.levenshtein("word", "near", 1) == 1)
    return probes.join(known, (F.col("key") == F.col("near_key")) & one_edit).select("word", "n", "near", "near_n")


# -- forms and roots -------------------------------------------------------------


def roots(forms: DataFrame, most: int, least: int, times: int) -> DataFrame:
    """``word, root`` of the words that have a form.

    Along forms n grows ``times``-fold, so their number is bounded by the largest n
    and each round doubles the steps taken.
    """
    steps = max(1, int(math.log(max(most, 1) / max(least, 1), times) + 1e-9)) if most > least else 1
    jump = forms.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        further = jump.select(F.col("word").alias("at"), F.col("root").alias("to"))
        jump = written(jump.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("to", "root").alias("root")), "roots")
    return jump


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = ONE_IN,
    least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, symbols: int | None = None,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``vocabulary``.

    A word's form is its near word of largest n (of ties the smallest), if that n
    is at least ``times`` the word's; ``root`` is where the forms end, the word
    itself without any.  Texts of any length, empty or null, and repeated rows are
    those of ``vocabulary``; only the two named columns are read, so others may
    have any name.  No words, no rows.  ``symbols`` is chosen by the vocabulary
    unless given, and changes no result.
    """
    words = written(vocabulary(docs, id_col, text_col, one_in, least_length, least_count), "vocabulary")
    letters = letters_by_frequency(words)
    near = near_words(words, letters, symbols or fewest_symbols(words, letters))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    much = -F.col("best.less") >= times * F.col("n")
    forms = written(
        found.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(much, F.col("best.near")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    most = forms.agg(F.max("n")).first()[0] or 0
    out = forms.join(roots(forms, most, least_count, times), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# crc32 by its table; characters above U+007F become one byte each, since levenshtein counts bytes
_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i)),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
bytes AS (
  SELECT run, n, list_transform(range(length(hx) // 2), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT)) AS b
  FROM (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hx FROM runs)),
hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || b, lambda c, x: xor(c // 256, tab[1 + xor(c % 256, x)])), 4294967295) AS h FROM bytes, crc),
vocab AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n, translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ',
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_`{|}~') AS bytes
  FROM (SELECT n, CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM vocab a JOIN vocab b
  ON length(b.word) BETWEEN length(a.word) - 1 AND length(a.word) + 1 AND levenshtein(a.bytes, b.bytes) = 1),
best AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n
  FROM vocab v LEFT JOIN best ON best.word = v.word AND r = 1),
walk AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT walk.word, forms.word, forms.form FROM walk JOIN forms ON forms.word = walk.next)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word AND w.next IS NULL
"""


@base.query("op11_spelling_variants", _SQL)
def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Words of the whole table with their forms and roots."""
    return variants(base.table(spark, sf_dir, "documents").select("doc_id", "text"))
