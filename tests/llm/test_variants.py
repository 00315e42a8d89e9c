import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkgauge.llm import op11_variants as o

from .helpers import odd_documents

LETTERS = "abcdéßÀ÷"


def vocabulary(rows, one_in, least_length, least_count):
    import re

    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least_length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least_count}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(rows, one_in=7, least_length=2, least_count=1, times=5):
    words = vocabulary(rows, one_in, least_length, least_count)
    found = {}
    for w, n in words.items():
        near = sorted(((-words[v], v) for v in words if one_edit(w, v)))
        form = near[0][1] if near and -near[0][0] >= times * n else None
        found[w] = (form, n, len(near), words[form] if form else None)
    out = []
    for w, (form, n, k, form_n) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out.append((w, form, root, n, k, form_n))
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    roots = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 5))) for _ in range(25)]
    words = []
    for r in roots:
        words += [r] * rng.choice([1, 3, 30, 200])
        for _ in range(4):
            k = rng.randrange(len(r))
            words += [rng.choice([r[:k] + r[k + 1 :], r[:k] + rng.choice(LETTERS) + r[k + 1 :], r[:k] + rng.choice(LETTERS) + r[k:]])] * rng.choice([1, 2, 8, 40])
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", "\n", "1", "-"]).join(words[i::40])) for i in range(40)]
    return rows + [(3, "Again AGAIN again"), (3, "Again AGAIN again"), (None, "abcd ABCD abcé"), (90, None), (91, ""), (92, "12 -- \n"), (93, "x" * 3000)]


@pytest.mark.parametrize("seed,symbols", [(1, None), (2, 1), (3, 2), (4, 8)])
def test_equal_to_all_pairs(spark, seed, symbols):
    rows = texts(seed)
    got = o.variants(odd_documents(spark, rows), one_in=7, least_length=2, least_count=1, symbols=symbols)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(plain(rows), key=str)


def test_long_chains_of_forms(spark):
    # b, bb, bbb ... each five times as frequent as the one before
    rows = [(i, " ".join("a" * (k + 1) for k in range(6) for _ in range(5**k))) for i in range(2)]
    got = {r.word: r for r in o.variants(odd_documents(spark, rows), one_in=10**9, least_length=1, least_count=1).collect()}
    assert got["a"].root == "a" * 6 and got["a"].form == "aa" and got["a" * 6].form is None and got["aaa"].n_near == 2


def test_long_text_and_flush(spark, monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(3000))
    monkeypatch.setattr(o, "HELD_WORDS", 10)
    monkeypatch.setattr(o, "HELD_CHARS", 100)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([5, 5]), pa.array([text, "abcde"])], names=["id", "text"])
    got = Counter()
    for b in o.word_batches(iter([batch]), 199, 2):
        for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
            got[w] += n
    assert got == vocabulary([(5, text), (5, "abcde")], 199, 2, 1)


def test_symbols_grow_with_the_vocabulary(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(20000)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    letters = o.letters_by_frequency(df)
    assert sorted(letters) == sorted("abcdefghijklmnop")
    few, many = o.fewest_symbols(df.limit(300), letters), o.fewest_symbols(df, letters)
    assert few < many


def test_the_join_puts_out_near_words_alone(spark):
    words = spark.createDataFrame([("a" * 6 + c + d, 5) for c in "bcdefg" for d in "bcdefg"], "word string, n long")
    near = o.near_words(words, o.letters_by_frequency(words), 2)
    assert near.count() == 36 * 10
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" in plan.split("Join", 1)[1].split("\n")[0]


def test_empty_table(spark):
    assert o.variants(odd_documents(spark, [(1, "a")]).where(F.lit(False))).count() == 0
