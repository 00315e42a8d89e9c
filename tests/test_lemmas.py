import random

from pyspark.sql import functions as F

from inkgauge.functions import text as X
from inkgauge.operators import lemmas as LE


def made(rng):
    """Words whose lemmas follow their endings, and some that do not."""
    pairs = {}
    for _ in range(600):
        stem = "".join(rng.choice("bcdflmnprt") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) + rng.choice("bdgkmnpt")
        for ending, put in (("ies", "y"), ("ss", "ss"), ("s", ""), ("ing", "e"), ("ed", "e"), ("en", "en")):
            if rng.random() < 0.5:
                pairs[stem + ending] = stem + put
    pairs.update({"mice": "mouse", "geese": "goose", "was": "be"})
    return pairs


def plain_endings(pairs, longest=6, least=2):
    votes = {}
    for t, lemma in pairs.items():
        k = 0
        while k < min(len(t), len(lemma)) and t[k] == lemma[k]:
            k += 1
        cut, put = len(t) - k, lemma[k:]
        for n in range(cut, min(longest, len(t)) + 1):
            rules = votes.setdefault(t[len(t) - n :], {})
            rules[cut, put] = rules.get((cut, put), 0) + 1
    return {e: min(r, key=lambda x: (-r[x], x)) for e, r in votes.items() if sum(r.values()) >= least}


def test_endings_and_held_out_accuracy(spark, monkeypatch):
    rng = random.Random(1)
    pairs = made(rng)
    held = {t for t in pairs if rng.random() < 0.25}
    known = {t: v for t, v in pairs.items() if t not in held}
    table = spark.createDataFrame([*known.items(), (None, "x"), ("y", None)], "token string, lemma string")
    endings = LE.learn_endings(table)
    rules = {r.ending: (r.cut, r.put) for r in endings.collect()}
    assert rules == plain_endings(known)
    tokens = spark.createDataFrame([(t,) for t in sorted(held)] + [("Running",), ("x",), ("",), (None,), ("classes",), ("ies",)], "token string")
    found = sorted(map(repr, LE.with_ending_lemmas(tokens, endings).collect()))
    got = {r.token: r.lemma for r in LE.with_ending_lemmas(tokens, endings).collect()}
    right = sum(got[t] == pairs[t] for t in held) / len(held)
    rule = {r.token: r.lemma for r in tokens.select("token", X.lemma(F.col("token")).alias("lemma")).collect()}
    before = sum(rule[t] == pairs[t] for t in held) / len(held)
    assert right > 0.95 and right > before + 0.4
    monkeypatch.setattr(LE, "small_rows", lambda table: None)
    assert sorted(map(repr, LE.with_ending_lemmas(tokens, endings).collect())) == found


def test_without_pairs_the_suffix_rule_stays(spark):
    none = spark.createDataFrame([], "token string, lemma string")
    tokens = spark.createDataFrame([("cats",), ("as",), (None,)], "token string")
    got = LE.with_ending_lemmas(tokens, LE.learn_endings(none)).collect()
    assert {r.token: r.lemma for r in got} == {"cats": "cat", "as": "as", None: None}


def test_a_table_comes_before_endings(spark):
    from inkgauge.operators.tokens import lemmatize_tokens

    table = spark.createDataFrame([("making", "make"), ("taking", "take"), ("king", "king")], "token string, lemma string")
    tokens = spark.createDataFrame([("king", 1), ("baking", 2), ("cats", 3)], "token string, nr int")
    got = {r.token: r.lemma for r in lemmatize_tokens(tokens, table, LE.learn_endings(table)).collect()}
    assert got == {"king": "king", "baking": "bake", "cats": "cat"}
