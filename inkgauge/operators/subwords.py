"""Subword vocabulary by pair merges, and encoding by the longest match.

The words of all texts are counted once; training works on distinct words.  A
word is a row of symbols, ``##`` before all but the first.  Each round merges the
most frequent neighbours: pair counts are a table, and only words that hold a
merged pair are looked at again to correct it.  Encoding takes the longest known
piece from the left inside each row, so no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import small_rows, written
from .tokens import framed_ids

#: Around every symbol of a word, so that a merge is a replacement of text.
OPEN, CLOSE = "\x02", "\x03"
CONTINUES = "##"
SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")
#: A longer word is unknown as a whole.
WORD_CHARS = 100
#: Pairs looked at for the merges of a round, and merges that are applied while scanning before the words are rewritten.
TOP_PAIRS, PENDING = 1000, 48
#: Most rows and bytes of a vocabulary that goes to the tasks.
VOCAB_ROWS, VOCAB_BYTES = 1_000_000, 64 * 1024 * 1024

Pair = tuple[str, str]


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``token, n``: the lower-case tokens of all texts."""
    return df.select(F.explode(X.tokenize(F.lower(F.col(text)))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def symbols_of(word: Column) -> Column:
    """The characters of a word as its first symbols, in one text."""
    parts = F.transform(F.split(word, ""), lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit(CONTINUES), c)))
    return F.concat(F.lit(OPEN), F.array_join(parts, CLOSE + OPEN), F.lit(CLOSE))


def joined(pair: Pair) -> str:
    return pair[0] + pair[1].removeprefix(CONTINUES)


def wrapped(*symbols: str) -> str:
    return "".join(f"{OPEN}{s}{CLOSE}" for s in symbols)


def merged(symbols: Column, pairs: Iterable[Pair]) -> Column:
    """The symbols with the pairs merged one after another, each from the left."""
    for pair in pairs:
        symbols = F.replace(symbols, F.lit(wrapped(*pair)), F.lit(wrapped(joined(pair))))
    return symbols


def pair_counts(words: DataFrame) -> DataFrame:
    """``left, right, n`` of the neighbours in ``symbols, n``; ``n`` may be negative."""
    parts = F.split(F.substring("symbols", F.lit(2), F.length("symbols") - 2), CLOSE + OPEN)
    some = words.select(parts.alias("s"), "n").where(F.size("s") > 1)
    pairs = F.arrays_zip(F.slice("s", F.lit(1), F.size("s") - 1).alias("left"), F.slice("s", F.lit(2), F.size("s") - 1).alias("right"))
    return some.select(F.explode(pairs).alias("p"), "n").groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def sure_merges(top: Sequence[tuple[str, str, int]], whole: bool, known: set[str], most: int) -> list[Pair]:
    """The next merges that one count of pairs decides; ``top`` is its beginning, the most frequent first.

    A merge changes the counts of pairs that share a symbol with it, and makes new
    pairs that are no more frequent than those were.  The next pair is still the
    best as long as it is apart from the merges and more frequent than every pair
    that is not.  A merge into a symbol that exists already can raise other counts,
    so it is the last of its round.
    """
    out: list[Pair] = []
    touched: set[str] = set()
    least = -1 if whole else top[-1][2]
    for left, right, n in top:
        if out:
            if len(out) >= most or left in touched or right in touched or n <= least:
                break
            if any(m >= n and (a in touched or b in touched) and (a, b) not in out for a, b, m in top):
                break
        out.append((left, right))
        touched |= {left, right}
        if joined((left, right)) in known:
            break
    return out


def train_subwords(
    df: DataFrame, size: int = 30_000, text: str = "text", merges: int | None = None, least: int = 2,
    alphabet: int = 1000, specials: Sequence[str] = SPECIALS,
) -> DataFrame:
    """``(token, token_id)``: special tokens, single symbols in code-point order, then merges in their order.

    The vocabulary ends at ``size`` tokens, after ``merges`` merges, or when no pair
    is ``least`` times there.  Of equally frequent pairs the first in code-point
    order is merged.  Symbols beyond the ``alphabet`` most frequent ones get no
    token.  Null and empty texts have no words; words of over ``WORD_CHARS``
    characters are not learned from.  No words, only special tokens.
    """
    spark = df.sparkSession
    counted = word_counts(df, text).where((F.length("token") <= WORD_CHARS) & ~F.col("token").rlike(f"[{OPEN}{CLOSE}]"))
    words = written(counted.select(symbols_of(F.col("token")).alias("symbols"), "n"), "words")
    single = words.select(F.explode(F.split(F.substring("symbols", F.lit(2), F.length("symbols") - 2), CLOSE + OPEN)).alias("s"), "n")
    first = single.groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(alphabet).collect()
    tokens = [*specials, *sorted(r["s"] for r in first)]
    known, done, pending = set(tokens), 0, []
    counts = written(pair_counts(words), "pairs")
    while len(tokens) < size and (merges is None or done < merges):
        rows = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "left", "right").limit(TOP_PAIRS).collect()
        if not rows:
            break
        most = min(size - len(tokens), size if merges is None else merges - done)
        now = sure_merges([tuple(r) for r in rows], len(rows) < TOP_PAIRS, known, most)
        for pair in now:
            if joined(pair) not in known:
                tokens.append(joined(pair))
                known.add(joined(pair))
        done += len(now)
        here = words.select(merged(F.col("symbols"), pending).alias("symbols"), "n")
        held = F.lit(False)
        for pair in now:
            held = held | F.contains("symbols", F.lit(wrapped(*pair)))
        changed = here.where(held)
        less = changed.select("symbols", (-F.col("n")).alias("n"))
        more = changed.select(merged(F.col("symbols"), now).alias("symbols"), "n")
        counts = counts.unionAll(pair_counts(less.unionAll(more))).groupBy("left", "right").agg(F.sum("n").alias("n"))
        counts = written(counts.where("n > 0"), "pairs")
        pending += now
        if len(pending) > PENDING:
            words, pending = written(words.select(merged(F.col("symbols"), pending).alias("symbols"), "n"), "words"), []
    return spark.createDataFrame(list(zip(tokens, range(len(tokens)))), "token string, token_id int")


# -- encoding --------------------------------------------------------------------


def trie_of(ids: dict[str, int]) -> dict:
    """Nested dictionaries by character; the number of a piece that ends there is under ``""``."""
    root: dict = {}
    for piece, number in ids.items():
        at = root
        for c in piece:
            at = at.setdefault(c, {})
        at[""] = number
    return root


def longest_pieces(word: str, first: dict, later: dict, unknown: int) -> list[int]:
    """Numbers of the longest pieces from the left; the unknown number alone where no piece fits."""
    out: list[int] = []
    at, trie = 0, first
    while at < len(word):
        node, end, number = trie, at, None
        for i in range(at, len(word)):
            node = node.get(word[i])
            if node is None:
                break
            if "" in node:
                end, number = i + 1, node[""]
        if number is None:
            return [unknown]
        out.append(number)
        at, trie = end, later
    return out


def subword_numbers(tokens: Column, ids: dict[str, int], most: int, unknown: int, specials: Sequence[str] = SPECIALS) -> Column:
    """Numbers of the pieces of a text of tokens joined by single blanks, the first ``most`` of them."""
    plain = {t: i for t, i in ids.items() if t not in specials}
    first = trie_of({t: i for t, i in plain.items() if not t.startswith(CONTINUES) or t == CONTINUES})
    later = trie_of({t[len(CONTINUES) :]: i for t, i in plain.items() if t.startswith(CONTINUES) and t != CONTINUES})

    def call(texts: pa.Array) -> pa.Array:
        found: dict[str, list[int]] = {}
        out = []
        for text in texts.to_pylist():
            row: list[int] = []
            for word in (text or "").split(" "):
                if word not in found:
                    found[word] = longest_pieces(word, first, later, unknown) if len(word) <= WORD_CHARS else [unknown]
                row += found[word]
                if len(row) >= most:
                    break
            out.append(row[:most])
        return pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(call, "array<int>")(tokens)


def encode_subwords(df: DataFrame, vocab: DataFrame, max_length: int = 128, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, input_ids, attention_mask, truncated``: subword ids, cut and padded to ``max_length``.

    Ids of the special tokens are pad 0, unknown 1, start 2, end 3.  Rows keep their
    places, whether keys repeat or are null; a null text is an empty one.  Of a
    token listed twice the smaller id counts.  The vocabulary is looked up inside
    the row and must be within ``VOCAB_ROWS`` and ``VOCAB_BYTES``.
    """
    room = max_length - 2
    table = written(vocab.where("token is not null").groupBy("token").agg(F.min("token_id").alias("token_id")), "vocab")
    rows = small_rows(table, VOCAB_ROWS, VOCAB_BYTES)
    if rows is None:
        raise ValueError(f"a subword vocabulary has at most {VOCAB_ROWS} tokens of {VOCAB_BYTES} bytes together")
    # a token has a piece at least, so no more of them are needed
    tokens = F.array_join(F.slice(X.tokenize(F.lower(F.col(text))), 1, room + 1), " ")
    number = subword_numbers(tokens, {r["token"]: r["token_id"] for r in rows}, room + 1, 1)
    ids = df.select(key, number.alias("_found"))
    ids = ids.select(key, F.slice("_found", 1, room).alias("body"), (F.size("_found") > room).alias("truncated"))
    return framed_ids(ids, max_length, key)
