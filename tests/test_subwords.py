import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkgauge.functions import text as X
from inkgauge.operators import subwords as SW

SF = "/root/testdata/sf0.001"


def plain_vocab(words, size=10**9, merges=10**9, least=2, alphabet=1000):
    """One merge after another in one process."""
    rows = [([w[0], *["##" + c for c in w[1:]]], n) for w, n in words.items() if len(w) <= SW.WORD_CHARS]
    single = Counter()
    for s, n in rows:
        for x in s:
            single[x] += n
    tokens = [*SW.SPECIALS, *sorted(sorted(single, key=lambda x: (-single[x], x))[:alphabet])]
    done = 0
    while len(tokens) < size and done < merges:
        pairs = Counter()
        for s, n in rows:
            for p in zip(s, s[1:]):
                pairs[p] += n
        best = min(((-n, p) for p, n in pairs.items() if n >= least), default=None)
        if best is None:
            break
        a, b = best[1]
        new = a + b.removeprefix("##")
        for s, _ in rows:
            i = 0
            while i + 1 < len(s):
                if s[i] == a and s[i + 1] == b:
                    s[i : i + 2] = [new]
                i += 1
        if new not in tokens:
            tokens.append(new)
        done += 1
    return tokens


def plain_pieces(word, tokens):
    ids, out, at = {t: i for i, t in enumerate(tokens) if t not in SW.SPECIALS}, [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in ids and not (at == 0 and piece.startswith("##") and piece != "##"):
                break
        else:
            return [1]
        out.append(ids[piece])
        at = end
    return out if len(word) <= SW.WORD_CHARS else [1]


def trained(spark, words, **options):
    df = spark.createDataFrame([(" ".join([w] * n),) for w, n in words.items()] + [(None,), ("",)], "text string")
    return [r["token"] for r in SW.train_subwords(df, **options).orderBy("token_id").collect()]


@pytest.mark.parametrize("seed", range(4))
def test_vocabulary_is_that_of_one_merge_after_another(spark, monkeypatch, seed):
    monkeypatch.setattr(SW, "TOP_PAIRS", [5, 1000, 1000, 8][seed])
    monkeypatch.setattr(SW, "PENDING", [2, 48, 3, 48][seed])
    rng = random.Random(seed)
    letters = ["ab", "abc", "abcdé", "abcdefgh"][seed]
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))): rng.randint(1, 6) for _ in range(40)}
    options = {"size": 40 if seed % 2 else 60, "least": 1 + seed % 2}
    assert trained(spark, words, **options) == plain_vocab(words, **options)


def test_vocabulary_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = {r.token: r.n for r in SW.word_counts(docs).collect()}
    got = [r["token"] for r in SW.train_subwords(docs, merges=40).orderBy("token_id").collect()]
    assert got == plain_vocab(words, merges=40)


def test_limits_and_odd_rows(spark):
    assert trained(spark, {"ab": 3, "ac": 2, "xy": 1}, alphabet=3, merges=1) == plain_vocab({"ab": 3, "ac": 2, "xy": 1}, alphabet=3, merges=1)
    assert trained(spark, {}) == list(SW.SPECIALS)
    assert len(trained(spark, {"a" * 200: 5, "bb": 2})) == 7
    assert trained(spark, {"aaaa": 3, "aaa": 1}) == plain_vocab({"aaaa": 3, "aaa": 1})


def test_a_round_takes_only_merges_its_counts_decide():
    top = [("a", "##b", 9), ("c", "##d", 8), ("##b", "##c", 7), ("e", "##f", 7), ("g", "##h", 6)]
    assert SW.sure_merges(top, True, set(), 10) == [("a", "##b"), ("c", "##d")]
    assert SW.sure_merges(top, True, {"ab"}, 10) == [("a", "##b")]
    assert SW.sure_merges(top, True, set(), 1) == [("a", "##b")]
    assert SW.sure_merges([("a", "##b", 9), ("c", "##d", 9)], False, set(), 10) == [("a", "##b")]
    assert SW.sure_merges([("a", "##b", 9), ("c", "##d", 7), ("x", "##b", 7)], True, set(), 10) == [("a", "##b")]


def test_encoding_takes_the_longest_pieces(spark):
    rng = random.Random(3)
    tokens = [*SW.SPECIALS, "a", "##a", "b", "##b", "ab", "##ab", "abab", "##bb", "é", "##c", "##"]
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(tokens)] + [("ab", 99), (None, 5)], "token string, token_id int")
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts += [None, "", "a" * 101, "a" * 100, "[PAD] ## [UNK]", "漢字", "ab " * 5000]
    rows = [(i % 50 if i % 7 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id int, text string, nr int")
    words = {r.nr: r.w for r in docs.select("nr", X.tokenize(F.lower("text")).alias("w")).collect()}
    got = {r.nr: r for r in SW.encode_subwords(docs, vocab, 16, key="nr").collect()}
    for nr, w in words.items():
        ids = [i for x in w for i in plain_pieces(x, tokens)]
        body = ids[:14]
        assert got[nr].input_ids == [2, *body, 3] + [0] * (14 - len(body))
        assert got[nr].attention_mask == [1] * (len(body) + 2) + [0] * (14 - len(body)) and got[nr].truncated == (len(ids) > 14)
    by_key = SW.encode_subwords(docs, vocab, 16)
    assert by_key.count() == len(rows)
    plan = by_key._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_vocabulary_too_large_for_tasks_is_refused(spark, monkeypatch):
    monkeypatch.setattr(SW, "VOCAB_ROWS", 2)
    vocab = spark.createDataFrame([("a", 4), ("b", 5), ("c", 6)], "token string, token_id int")
    with pytest.raises(ValueError, match="at most 2 tokens"):
        SW.encode_subwords(spark.createDataFrame([(1, "a")], "doc_id int, text string"), vocab)
