import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkgauge.functions import text as X


@pytest.mark.parametrize(
    "fn, given, want",
    [
        (X.strip_task_prefix, "Task 3. abc", "abc"),
        (X.strip_task_prefix, "Tasks are", "s are"),
        (X.strip_task_prefix, "task one", "task one"),
        (X.newlines_to_space, "a\r\n\nb", "a b"),
        (X.collapse_whitespace, "  a \t b  c ", "a b c"),
        (X.strip_punctuation, "a-b (c)! d,e?", "ab c! d,e?"),
        (X.strip_punctuation, "naïve «œuvre» 12_3", "naïve œuvre 12_3"),
        (X.drop_upper_tokens, "x AB_CD y", "x  y"),
        (X.strip_emoji, "ok 😀 fine ☀", "ok  fine "),
        (X.markdown_to_text, "# Title\n\n**bold** and *it* [link](http://x) &amp; `code`", "Title\n\nbold and it link & code"),
        (X.markdown_to_text, "<p>a <b>b</b></p><script>var x;</script>", "a b"),
        (X.markdown_to_text, "a < b and c > d", "a < b and c > d"),
        (X.clean_text, "A'B_C", ""),
        (X.clean_text, "", ""),
        (X.clean_text, "Task 1. The cats, dogs!", "The cat , dog !"),
    ],
)
def test_text_functions(one, fn, given, want):
    assert one(fn(F.col("t")), t=given) == want


def test_serving_order_differs(one):
    assert one(X.clean_text(F.col("t"), order="serving"), t="A'B_C") == "A"
    with pytest.raises(ValueError):
        X.clean_text(F.lit("a"), order="other")


def test_null_text_has_no_tokens(one):
    assert one(X.tokenize(F.lit(None).cast("string"))) == []
    assert one(X.clean_text(F.lit(None).cast("string"))) is None


def test_tokens_and_sentences(one):
    assert one(X.tokenize(F.col("t")), t="It's 3.5!") == ["It", "'", "s", "3", ".", "5", "!"]
    assert one(X.sentences(F.col("t")), t="One. Two! 3.5 three?  ") == ["One.", "Two!", "3.5 three?"]
    assert one(X.sentences(F.col("t")), t=" ") == []


@pytest.mark.parametrize("t, tag", [("quickly", "RB"), ("Running", "VBG"), ("walked", "VBD"), ("nation", "NN"), ("famous", "JJ"), ("the", "DT"), (",", ","), ("house", "NN"), ("é", "DT")])
def test_suffix_tags(one, t, tag):
    assert one(X.suffix_tag(F.col("t")), t=t) == tag


def test_lemma(one):
    assert one(X.lemma(F.col("t")), t="Cats") == "cat"
    assert one(X.lemma(F.col("t")), t="Gas") == "gas"


@pytest.mark.parametrize("text", ["", "a", "aaaa", "abcd", "The cat.\nÉté 😀😀", "x" * 5000 + "y"])
def test_entropy(one, text):
    got = one(X.textual_entropy(F.col("t")), t=text)
    n = len(text)
    want = -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0
    assert got == pytest.approx(want, abs=1e-9)
    assert got <= math.log2(max(1, len(set(text)))) + 1e-9


def test_counts(one):
    row = one(X.text_counts(F.col("t")), t="The beautiful été. Hmm, ok!")
    assert row.asDict() == {
        "n_words": 5, "n_sentences": 2, "n_letters": 20, "n_characters": 23, "n_syllables": 8, "n_polysyllables": 1,
    }


def test_density_of_empty(one):
    assert one(X.density_of(X.tokenize(F.lit("")))) == 0.0
    assert one(X.density_of(X.tokenize(F.lit("the house, 12")))) == pytest.approx(1 / 3)


def test_a_final_s_goes_from_words_however_long(spark):
    texts = ["ssss sss", "cats. bus dress", "s" * 9000, "sa" * 9000 + "s", "a_1s\U0001d49cs", "\U0001d49c\U0001d49c\U0001d49cs", "éééss-s", "", None]
    want = [t if t is None else re.sub(r"(\w{3,})s(?!\w)", r"\1", t) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.x for r in df.select("i", X.lemmatize_text("t").alias("x")).orderBy("i").collect()] == want
