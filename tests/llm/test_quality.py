import random

import pyarrow as pa
from pyspark.sql import functions as F

from inkgauge.llm import op1_rules as o
from inkgauge.llm import op6_lines as lines

from .helpers import odd_documents, sentence, words

SMALL = "/root/testdata/sf0.01"
ODD = [(900, None), (901, ""), (902, " \n \n"), (903, "a"), (904, "b\n" * 5000), (905, "x" * 100_000), (None, "a b c"), (906, "p q r s t p q r s t")]


def test_rules_score_held_out_documents(spark):
    rows = o.op1_quality_rules(spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert sum(r.predicted == r.quality for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_model_without_two_labels_and_odd_texts(spark):
    stats = o.with_statistics(odd_documents(spark, ODD))
    assert stats.count() == len(ODD)
    assert stats.where(" or ".join(f"stats.{s} is null or isnan(stats.{s})" for s in o.STATISTICS)).count() == 0
    for label in (None, 1, 0):
        model = o.fit_rules(stats.withColumn("label", F.lit(label).cast("int")))
        scores = {r[0] for r in stats.select(model.score()).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1
    assert o.fit_rules(stats.withColumn("label", F.lit(1)).limit(0)).bias == 0


def test_statistics_by_hand():
    got = o.statistics(pa.array(["Aa b, c. D!\nAa b, c. D!\nÉ #", None])).to_pylist()
    a = got[0]
    assert a["duplicate_line_share"] == 1 / 3 and a["words_per_line"] == 10 / 3 and a["ended_line_share"] == 2 / 3
    assert a["distinct_share"] == 6 / 10 and a["top_word_share"] == 2 / 10 and a["mark_rate"] == 2 / 10
    assert abs(a["upper_share"] * len("Aa b, c. D!\nAa b, c. D!\nÉ #".encode()) - 5) < 1e-9
    assert got[1]["log_words"] == 0 and got[1]["longest_word"] == 0


def test_paths_of_trees():
    text = """RandomForestClassificationModel: numTrees=1
  Tree 0 (weight 1.0):
    If (feature 2 <= 0.5)
     If (feature 0 <= 1.0E-4)
      Predict: 0.0
     Else (feature 0 > 1.0E-4)
      Predict: 1.0
    Else (feature 2 > 0.5)
     Predict: 0.0"""
    a, b = o.STATISTICS[2], o.STATISTICS[0]
    assert o.tree_rules(text) == [((a, False, 0.5),), ((b, False, 1e-4), (a, False, 0.5)), ((b, True, 1e-4), (a, False, 0.5)), ((a, True, 0.5),)]


def plain_counts(text):
    ws, ls = words(text), (text or "").split("\n")
    grams = {}
    for i in range(len(ws) - 4):
        grams.setdefault(tuple(ws[i : i + 5]), []).append(i)
    covered = {p for at in grams.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    dup = sum(1 for i, x in enumerate(ls) if words(x) and x in ls[:i])
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_line_rules(spark):
    rng = random.Random(1)
    good = ". ".join(sentence(rng, 9).capitalize() for _ in range(6)) + "."
    rows = ODD + [
        (1, good), (2, good + "\nHome\nAll rights reserved.\nMenu | About | Contact | More"), (3, "a | b | c | d | e | f | g | h | i | j | k\n" * 2 + good[:40] + "."),
        (4, "\n".join(["Yes!! No!! Go!! Do!! Be!! So!!", "Zu!! Ze!! Zi!! Zo!! Za!! Zy!!"])), (5, good + "\n" + good), (6, "naïve café " * 3 + good + "\n" + good[:30]),
        (7, "漢字 " * 9 + "終わり。\n" + good), (8, "a &lt; # % " * 12),
    ]
    got = {r.doc_id: r.quality for r in lines.clean_lines(odd_documents(spark, rows)).collect()}
    for i, t in rows:
        q = got[i]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == plain_counts(t)
        assert q.base_failed == (q.n_words < 10 or 100 * q.n_repeat_words > 20 * q.n_words)
        assert not (q.base_failed and q.kept)
    assert got[1].kept and got[1].clean_text == good
    assert got[2].kept and got[2].clean_text == good and got[2].n_lines_removed == 3
    assert not any(got[i].kept for i in (3, 4, 5, 8)) and got[7].kept
    assert lines.clean_lines(odd_documents(spark, rows).limit(0)).count() == 0
