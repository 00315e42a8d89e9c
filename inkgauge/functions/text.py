"""Text cleaning, tokens, sentences and in-row text measures.

Everything here is a Column expression: a document is cleaned and measured
inside its own row, so these steps never shuffle.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import EMOJI_RANGES, MEANING_TAGS
from .base import as_col, let, safe_div
from .inrow import character_entropy

# Java and RE2 know only ASCII behind \w and \s, so the classes are spelled out.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
TOKEN = rf"{WORD}+|[^{SPACE}]"
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ"
KEEP = ".?!,"

# Markdown and HTML constructs taken out, in order of application: a trigger
# character and the rules that can only match where it occurs.
MARKDOWN_RULES = (
    ("<", (
        (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""),
        (r"(?s)<!--.*?-->", ""),
        (r"<[/!]?[A-Za-z][^>]*>", ""),
    )),
    ("[", (
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    )),
    ("", (
        (r"(?m)^[ \t]*(?:[-*_][ \t]*){3,}$", ""),
        (r"(?m)^[ \t]*(?:#{1,6}[ \t]+|>[ \t]?|[*+-][ \t]+|[0-9]+\.[ \t]+)", ""),
    )),
    ("*", (
        (r"\*\*([^*]+)\*\*", "$1"),
        (r"\*([^*\s][^*]*)\*", "$1"),
    )),
    ("`", ((r"`([^`]*)`", "$1"),)),
    ("&", (
        (r"&nbsp;", " "),
        (r"&lt;", "<"),
        (r"&gt;", ">"),
        (r"&quot;", '"'),
        (r"&#39;", "'"),
        (r"&amp;", "&"),
    )),
)


def _sub(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(replacement))


# -- cleaning ---------------------------------------------------------------

def markdown_to_text(c: Column | str) -> Column:
    """Plain text of a markdown/HTML string (the documented subset of rules)."""

    def apply(col: Column, trigger: str, rules) -> Column:
        out = col
        for pattern, replacement in rules:
            out = _sub(out, pattern, replacement)
        return F.when(col.contains(trigger), out).otherwise(col) if trigger else out

    out = as_col(c)
    for trigger, rules in MARKDOWN_RULES:
        out = let(out, partial(apply, trigger=trigger, rules=rules)) if trigger else apply(out, "", rules)
    return _sub(out, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def newlines_to_space(c: Column | str) -> Column:
    return _sub(as_col(c), r"[\r\n]+", " ")


def collapse_whitespace(c: Column | str) -> Column:
    return F.trim(_sub(as_col(c), rf"[{SPACE}]+", " "))


def strip_task_prefix(c: Column | str) -> Column:
    """Case-sensitive and without a word boundary: ``Tasks are`` -> ``s are``."""
    return _sub(as_col(c), rf"^(?:Task(?:[{SPACE}]*\p{{Nd}}+)?\.?[{SPACE}]*)?", "")


def drop_upper_tokens(c: Column | str) -> Column:
    return _sub(as_col(c), r"[A-Z]+_[A-Z]+", "")


def strip_punctuation(c: Column | str, keep: str = KEEP) -> Column:
    kept = "".join("\\" + ch if ch in r"\]^-[&" else ch for ch in keep)
    return _sub(as_col(c), rf"[^\p{{L}}\p{{N}}_{SPACE}{kept}]", "")


def strip_emoji(c: Column | str) -> Column:
    ranges = "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in EMOJI_RANGES)
    return _sub(_sub(as_col(c), r"\n+", " "), f"[{ranges}]+", "")


def lemmatize_text(c: Column | str) -> Column:
    """Noun-suffix rule on a whole text: a final ``s`` goes from longer words.

    A word is walked through once: three letters, then all up to an ``s`` that ends it.
    """
    others = r"[\p{L}\p{N}_&&[^s]]"
    return _sub(as_col(c), rf"(?<!{WORD})({WORD}{{3}}{others}*+(?:s(?={WORD}){others}*+)*+)s(?!{WORD})", "$1")


def join_tokens(c: Column | str, marks: str = rf"[^\p{{L}}\p{{N}}_{SPACE}]") -> Column:
    """Tokens of a text joined by single blanks, without building an array; ``marks`` are all there can be."""
    return collapse_whitespace(_sub(as_col(c), f"({marks})", " $1 "))


def clean_text(c: Column | str, order: str = "batch", lemmatize: bool = True, emoji: bool = False) -> Column:
    """The cleaning chain.

    ``order='batch'`` drops UPPER_TOKENS after punctuation, ``'serving'`` before
    it, so ``A'B_C`` becomes empty in the first and ``A`` in the second.
    """
    if order not in ("batch", "serving"):
        raise ValueError(f"unknown cleaning order {order!r}")
    out = markdown_to_text(c)
    out = collapse_whitespace(newlines_to_space(out))
    out = strip_task_prefix(out)
    if order == "serving":
        out = strip_punctuation(drop_upper_tokens(out))
    else:
        out = strip_punctuation(out)
        if emoji:
            out = strip_emoji(out)
        out = drop_upper_tokens(out)
    if lemmatize:
        out = lemmatize_text(out)
    return join_tokens(out, f"[{KEEP}]")


# -- tokens and sentences ---------------------------------------------------

def tokenize(c: Column | str) -> Column:
    """Words and single marks; a null text has no tokens."""
    return F.coalesce(F.regexp_extract_all(as_col(c), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(as_col(c), F.lit(f"{WORD}+"), F.lit(0))


def sentences(c: Column | str) -> Column:
    """Split after ``. ? !`` followed by whitespace; blank pieces are dropped."""
    parts = F.split(as_col(c), rf"(?<=[.?!])[{SPACE}]+")
    return F.filter(parts, lambda s: F.length(F.trim(s)) > 0)


def is_word_or_punct(t: Column) -> Column:
    """Alphabetic tokens and ASCII punctuation."""
    return t.rlike(r"^(?:\p{L}+|[!-/:-@\[-`{-~])$")


def lemma(t: Column, lowered: bool = False) -> Column:
    """Noun-suffix fallback: lower case, final ``s`` off when longer than 3."""
    low = t if lowered else F.lower(t)
    return F.when(low.endswith("s") & (F.length(low) > 3), F.left(low, F.length(low) - 1)).otherwise(low)


def suffix_tag(t: Column, lowered: bool = False) -> Column:
    """Fallback tag for tokens without an entry in a tag table; a mark is its own tag."""
    return lowered_tag(t, t if lowered else F.lower(t))


def lowered_tag(t: Column, low: Column) -> Column:
    """The fallback tag of a token from its lower-case form ``low``."""

    def ends(*suffixes: str) -> Column:
        out = low.endswith(suffixes[0])
        for s in suffixes[1:]:
            out = out | low.endswith(s)
        return out

    return (
        F.when(ends("ly"), "RB")
        .when(ends("ing"), "VBG")
        .when(ends("ed"), "VBD")
        .when(ends("tion", "ment", "ness"), "NN")
        .when(ends("able", "ous", "ful"), "JJ")
        .when(F.length(low) > 3, "NN")
        .when(low.rlike(WORD), "DT")
        .otherwise(t)
    )


def tagged_text(tokens: Column, tags: Column) -> Column:
    """``word/TAG`` pairs joined by blanks."""
    return F.array_join(F.zip_with(tokens, tags, lambda w, t: F.concat(w, F.lit("/"), t)), " ")


# -- in-row measures --------------------------------------------------------

COUNTS = ("n_words", "n_sentences", "n_letters", "n_characters", "n_syllables", "n_polysyllables")


def text_counts(c: Column | str) -> Column:
    """A struct of ``COUNTS``; a word has as many syllables as vowel groups, at least one."""
    text = as_col(c)

    def counted(per_word: Column) -> Column:
        total = F.aggregate(per_word, F.lit(0).cast("bigint"), lambda acc, n: acc + n)
        return F.struct(
            F.size(per_word).cast("bigint").alias("n_words"),
            F.size(sentences(text)).cast("bigint").alias("n_sentences"),
            F.length(_sub(text, r"[^\p{L}]+", "")).cast("bigint").alias("n_letters"),
            F.length(_sub(text, rf"[{SPACE}]+", "")).cast("bigint").alias("n_characters"),
            total.alias("n_syllables"),
            F.size(F.filter(per_word, lambda n: n >= 3)).cast("bigint").alias("n_polysyllables"),
        )

    groups = F.transform(
        words(F.lower(text)), lambda w: F.greatest(F.lit(1), F.regexp_count(w, F.lit(f"[{VOWELS}]+")))
    )
    return let(groups, counted)


def textual_entropy(c: Column | str) -> Column:
    """Shannon entropy (bits) of the characters; empty text is 0.

    Characters are counted in one array of bounded size, however long the text is.
    """
    return character_entropy(as_col(c))


def density_of(tokens: Column) -> Column:
    """Share of meaning-bearing tags among lower-cased word-or-punctuation tokens."""

    def share(kept: Column) -> Column:
        bearing = F.filter(kept, lambda t: suffix_tag(t, lowered=True).isin(*MEANING_TAGS))
        return safe_div(F.size(bearing), F.size(kept))

    return let(F.filter(tokens, is_word_or_punct), share)


def tagged_of(tokens: Column) -> Column:
    """``word/TAG`` text of the lower-cased word-or-punctuation tokens."""
    kept = F.filter(tokens, is_word_or_punct)
    return let(kept, lambda k: F.array_join(F.transform(k, lambda t: F.concat(t, F.lit("/"), suffix_tag(t, lowered=True))), " "))
