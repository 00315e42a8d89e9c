"""Quality classifier: a sparse ensemble of rules over text statistics.

Paths of shallow trees become conjunctive rules over the statistics; a logistic
regression with a lasso penalty weighs them; the rules with a weight are compiled
into one Spark column expression over the statistics.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base
from ..session import written
from .op6_lines import byte_table, line_hashes, sums_at
from .op8_order_minhash import occurrences
from .words import U, Words, covered, mix, slices

STATISTICS = (
    "log_words", "word_length", "symbol_share", "mark_rate", "bar_rate", "stop_rate", "comma_rate", "digit_share",
    "upper_share", "non_ascii_share", "distinct_share", "top_word_share", "repeat_share", "duplicate_line_share",
    "words_per_line", "ended_line_share", "longest_word", "blank_share",
)
#: Labelled documents the rules are learned from, about; a hash of the id chooses them.
TRAIN_ROWS = 30_000
TREES, DEPTH, SEED = 24, 3, 5
LASSO, ITERATIONS = 0.002, 60
FOLDS, FOLD, ACCEPT = 5, 0, 0.3

SYMBOLS, MARKS, BARS, STOPS, COMMAS, DIGITS, CAPITALS, BLANKS = (
    byte_table(s) for s in ("#*$%&|<>", "!?", "|", ".!?", ",;", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", " \t\n\r\x0b\x0c")
)


def rate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def statistics(texts: pa.Array) -> pa.StructArray:
    """The statistics of each text, all finite; 0 where a text has nothing to count."""
    texts = texts.cast(pa.string()).fill_null("")
    words = Words(texts)
    n, docs = words.counts, words.docs
    data, offsets = words.data, words.offsets
    size = np.diff(offsets)
    count = lambda table: sums_at(table[data], offsets)
    blanks = count(BLANKS)
    # capitals of the Latin supplement too: 0xC3 before 0x80 to 0x9E
    upper = CAPITALS[data]
    if len(data) > 1:
        upper = upper.copy()
        upper[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    key = words.hash ^ mix(words.doc.astype(U) + U(1))
    seen = occurrences(key)
    distinct = np.bincount(words.doc[seen == 0], minlength=docs)
    top = np.zeros(docs, dtype=np.int64)
    np.maximum.at(top, words.doc, seen + 1)
    hashes, same = words.windows(5)
    place = np.flatnonzero(same)
    key = hashes[place] ^ mix(words.doc[place].astype(U) + U(1))
    again = occurrences(key) > 0
    repeat = np.bincount(words.doc[covered(place[again], 5, len(words))], minlength=docs)
    longest = np.zeros(docs, dtype=np.int64)
    np.maximum.at(longest, words.doc, words.end - words.start)
    split = pc.split_pattern(texts, "\n")
    of = np.repeat(np.arange(docs), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    lines = Words(split.flatten())
    with_word = np.flatnonzero(lines.counts > 0)
    n_lines = np.bincount(of[with_word], minlength=docs)
    same_line = occurrences(line_hashes(lines)[with_word] ^ mix(of[with_word].astype(U) + U(1))) > 0
    last = lines.data[lines.end[lines.begin[with_word + 1] - 1] - 1]
    ended = np.bincount(of[with_word], weights=(STOPS[last] | (last == 0x22)), minlength=docs)
    columns = [
        np.log1p(n), rate(size - blanks, n), rate(count(SYMBOLS), size), rate(count(MARKS), n), rate(count(BARS), n),
        rate(count(STOPS), n), rate(count(COMMAS), n), rate(count(DIGITS), size), rate(sums_at(upper, offsets), size),
        rate(sums_at(data >= 0x80, offsets), size), rate(distinct, n), rate(top, n), rate(repeat, n),
        rate(np.bincount(of[with_word][same_line], minlength=docs), n_lines), rate(n, n_lines), rate(ended, n_lines),
        longest, rate(blanks, size),
    ]
    return pa.StructArray.from_arrays([pa.array(np.asarray(c, dtype=np.float64)) for c in columns], names=list(STATISTICS))


def statistics_column(text: Column) -> Column:
    def call(texts: pa.Array) -> pa.Array:
        parts = [statistics(p.column("text")) for p in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text")]
        return pa.concat_arrays(parts) if parts else statistics(pa.array([], pa.string()))

    return F.arrow_udf(call, ", ".join(f"{s} double" for s in STATISTICS)).asNondeterministic()(text)


#: A condition: statistic, whether it must be above, threshold.
Condition = tuple[str, bool, float]


@dataclass
class RuleModel:
    rules: list[tuple[Condition, ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    def score(self, stats: str = "stats") -> Column:
        """The chance of label 1 as an expression over the struct of statistics."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(holds(rule, stats), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def holds(rule: tuple[Condition, ...], stats: str) -> Column:
    parts = [F.col(f"{stats}.{name}") > t if above else F.col(f"{stats}.{name}") <= t for name, above, t in rule]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def tree_rules(debug: str) -> list[tuple[Condition, ...]]:
    """The path to every node of the trees in Spark's printed form."""
    rules, path = [], []
    for line in debug.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+\d.eE]+)\)", line)
        if line.strip().startswith("Tree "):
            path = []
        if found:
            depth = len(found[1])
            path = [p for p in path if p[0] < depth] + [(depth, (STATISTICS[int(found[2])], found[3] == ">", float(found[4])))]
            rules.append(tuple(simplified([c for _, c in path])))
    return list(dict.fromkeys(rules))


def simplified(path: list[Condition]) -> list[Condition]:
    """One condition for each statistic and side, in a fixed order."""
    least: dict[tuple[str, bool], float] = {}
    for name, above, t in path:
        key = (name, above)
        least[key] = t if key not in least else (max if above else min)(least[key], t)
    return [(name, above, t) for (name, above), t in sorted(least.items())]


def fit_rules(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> RuleModel:
    """Learns from ``id, stats, label``; rows without a 0 or 1 label do not count.

    No row, or one label only, gives the smoothed share of label 1 for all.
    """
    rows = rows.where(F.col("label").isin(0, 1)).select("id", "stats", F.col("label").cast("double").alias("label"))
    sizes = {int(r[0]): r[1] for r in rows.groupBy("label").count().collect()}
    n = sum(sizes.values())
    if len(sizes) < 2:
        return RuleModel(bias=float(np.log((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1))))
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(SEED)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = written(rows.where(draw < min(1.0, train_rows / n)).select("label", "stats"), "quality-sample")
    names = [F.col(f"stats.{s}").alias(s) for s in STATISTICS]
    table = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(sample.select("label", *names))
    forest = RandomForestClassifier(
        labelCol="label", numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.5, featureSubsetStrategy="onethird", maxBins=64, seed=SEED
    ).fit(table.select("label", "features"))
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return RuleModel(bias=float(np.log((sizes[1] + 1) / (sizes[0] + 1))))
    as_columns = [holds(rule, "stats").cast("double").alias(f"r{i}") for i, rule in enumerate(rules)]
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(
        sample.select("label", *as_columns)
    )
    held = written(held.select("label", "features"), "quality-rules")
    lasso = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=ITERATIONS).fit(held)
    weights = lasso.coefficients.toArray()
    used = [i for i in range(len(rules)) if weights[i] != 0]
    return RuleModel([rules[i] for i in used], [float(weights[i]) for i in used], float(lasso.intercept))


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, stats`` of every row, written once; nulls are empty texts, whole texts are read."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), statistics_column(F.col(f"`{text_col}`")).alias("stats"))
    return written(rows, "statistics")


@base.query("op1_quality_rules")
def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Scores of every document by rules learned from four folds out of five.

    An empty text has statistics of 0 and a score; a document with several labels
    counts once for each.
    """
    stats = with_statistics(base.table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = base.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    model = fit_rules(stats.join(labels.where(~base.held_out("id", FOLDS, FOLD)), "id"))
    score = model.score("stats")
    return stats.select(
        F.col("id").alias("doc_id"), base.held_out("id", FOLDS, FOLD).alias("held_out"), score.alias("score"),
        F.when(score >= ACCEPT, 1).otherwise(0).alias("predicted"),
    )
