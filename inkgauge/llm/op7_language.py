"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Texts become lower-case letters, any run of other characters one space; their
n-grams of 1 to 3 characters are hashed to a fixed number of dimensions.
Document frequencies are counted over all documents that may be learned from;
weights are trained by follow-the-regularised-leader with elastic-net penalties
on a bounded sample of them; a temperature is fitted on a part kept out of it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base
from .words import slices, text_bytes

DIMENSIONS, LONGEST = 8192, 3
#: Labelled documents of each language the weights are trained on, about.
PER_LANGUAGE = 1000
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 0.002, 0.0001, 4
#: Share of the sample the temperature is fitted on.
CALIBRATION = 0.25
UNKNOWN = "und"
FOLDS, FOLD = 4, 2
#: Texts counted at once.
ROWS, BYTES = 256, 1_000_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """The lower-case letter of each code point, a space for any other character."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha() and unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def gram_counts(texts: pa.Array, dimensions: int = DIMENSIONS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams, a row a text, and whether a text has a letter."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    sizes = pc.utf8_length(texts.cast(pa.large_string()).fill_null("")).to_numpy(zero_copy_only=False)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    chars = letters()[points]
    doc = np.repeat(np.arange(n, dtype=np.int64), sizes)
    space = chars == 32
    keep = np.ones(len(chars), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1] & (doc[1:] == doc[:-1]))
    chars, doc = chars[keep], doc[keep]
    some = np.bincount(doc[chars != 32], minlength=n) > 0
    out = np.zeros(n * dimensions, dtype=np.int64)
    hashed = np.zeros(len(chars), dtype=np.uint32)
    for k in range(min(longest, len(chars))):
        # the hash of k characters goes on by the next one
        m = len(chars) - k
        hashed = (hashed[:m] ^ chars[k:]) * np.uint32(0x9E3779B1)
        hashed ^= hashed >> np.uint32(15)
        whole = doc[:m] == doc[k:]
        place = (hashed * np.uint32(0x85EBCA77)) >> np.uint32(32 - (dimensions - 1).bit_length())
        out += np.bincount(doc[:m][whole] * dimensions + place[whole], minlength=n * dimensions)
    return out.reshape(n, dimensions), some


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield from slices(batch.slice(at, ROWS), "text", BYTES)


def frequency_batches(batches: Iterator[pa.RecordBatch], dimensions: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Documents with each n-gram, summed over a partition; the last row counts all documents."""
    total = np.zeros(dimensions + 1, dtype=np.int64)
    for batch in batches:
        for part in pieces(batch):
            counts, _ = gram_counts(part.column("text"), dimensions, longest)
            total[:-1] += (counts > 0).sum(axis=0)
            total[-1] += len(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions + 1)), pa.array(total)], names=["dim", "df"])


def sample_batches(batches: Iterator[pa.RecordBatch], dimensions: int, longest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            counts, _ = gram_counts(part.column("text"), dimensions, longest)
            row, dim = np.nonzero(counts)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(counts)))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("lang"), part.column("draw"),
                    pa.ListArray.from_arrays(offsets, pa.array(dim.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(counts[row, dim].astype(np.int32))),
                ],
                names=["lang", "draw", "dims", "counts"],
            )


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray  # (dimensions,)
    weights: np.ndarray  # (dimensions + 1, languages), the last row is the bias
    temperature: float
    longest: int = LONGEST

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        x = counts.astype(np.float32) * self.idf.astype(np.float32)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
        logits = (x @ self.weights[:-1].astype(np.float32)) / np.maximum(norm, 1e-12)[:, None] + self.weights[-1]
        return softmax(logits / self.temperature)

    def predict(self, texts: pa.Array) -> pa.Array:
        """``lang_pred`` and ``score`` of each text."""
        found, score = [], []
        for part in pieces(pa.RecordBatch.from_arrays([texts], names=["text"])):
            counts, some = gram_counts(part.column("text"), len(self.idf), self.longest)
            if not self.languages:
                some[:] = False
            best = np.zeros(len(counts), dtype=np.int64)
            p = np.zeros(len(counts))
            if some.any():
                prob = self.probabilities(counts[some])
                best[some], p[some] = prob.argmax(axis=1), prob.max(axis=1)
            found += [self.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())]
            score.append(np.clip(p, 0, 1))
        values = np.concatenate(score) if score else np.empty(0)
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(values, pa.float64())], names=["lang_pred", "score"])

    def column(self, text: Column) -> Column:
        """The prediction as a column; evaluated once a row."""
        predict = self.predict

        def call(texts: pa.Array) -> pa.Array:
            return predict(texts)

        return F.arrow_udf(call, "lang_pred string, score double").asNondeterministic()(text)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], dimensions: int, classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after each epoch's pass over (dims, values, class); the last row is the bias."""
    z, n = np.zeros((dimensions + 1, classes)), np.zeros((dimensions + 1, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        step = (BETA + np.sqrt(ni)) / ALPHA + L2
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / step)

    order = np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            dims, values, label = rows[i]
            dims, values = np.append(dims, dimensions), np.append(values, 1.0)
            zi, ni = z[dims], n[dims]
            w = weights(zi, ni)
            error = softmax(values @ w)
            error[label] -= 1
            g = values[:, None] * error
            grown = ni + g * g
            z[dims] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
            n[dims] = grown
    return weights(z, n)


def fit_temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(label):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(label)), label], 1e-300)).mean())

    low, high, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit_languages(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
    per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS, longest: int = LONGEST,
) -> LanguageModel:
    """Learns from rows with a language and a text; all are counted, about ``per_language`` of each are trained on.

    The sample is drawn by a hash of id and text, so it does not depend on how
    rows are split.  No labelled row gives a model that knows no language.
    ``dimensions`` is a power of two.
    """
    rows = labelled.select(
        F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").cast("string").alias("id")
    ).where("lang is not null and text is not null")
    draw = F.pmod(F.xxhash64("id", F.md5(F.col("text").cast("binary"))), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    frequency = rows.select("text").mapInArrow(partial(frequency_batches, dimensions=dimensions, longest=longest), "dim long, df long")
    df = np.zeros(dimensions + 1)
    for dim, count in frequency.groupBy("dim").agg(F.sum("df")).collect():
        df[dim] = count
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], idf, np.zeros((dimensions + 1, 0)), 1.0, longest)
    share = F.lit(0.0)
    for name, size in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(per_language / size)).otherwise(share)
    sample = rows.withColumn("draw", draw).where(F.col("draw") < share).select("lang", "draw", "text")
    found = sample.mapInArrow(
        partial(sample_batches, dimensions=dimensions, longest=longest), "lang string, draw double, dims array<int>, counts array<int>"
    ).toArrow()
    number = {name: i for i, name in enumerate(languages)}
    # one array for all rows, which is given back as a whole; a row is a part of it
    dims, values = (np.concatenate([np.empty(0, dtype=np.int32), *[c.flatten().to_numpy() for c in found.column(n).chunks]]) for n in ("dims", "counts"))
    ends = np.cumsum(pc.list_value_length(found.column("dims")).to_numpy())
    drawn = [found.column(c).to_pylist() for c in ("lang", "draw")]
    del found
    pa.default_memory_pool().release_unused()
    values = values * idf[dims]
    data = []
    for lang, at, start, end in zip(*drawn, np.append(0, ends[:-1]), ends):
        x = values[start:end]
        norm = np.sqrt((x * x).sum())
        if norm:
            x /= norm
            data.append((at * sizes[lang], dims[start:end], x, number[lang]))
    data.sort(key=lambda r: (r[0], r[3]))
    every = max(2, round(1 / CALIBRATION))
    train, kept = [r[1:] for i, r in enumerate(data) if i % every], [r[1:] for r in data[::every]]
    weights = train_ftrl(train, dimensions, len(languages))
    logits = np.array([x @ weights[dims] + weights[-1] for dims, x, _ in kept]).reshape(-1, len(languages))
    return LanguageModel(languages, idf, weights, fit_temperature(logits, np.array([y for *_, y in kept], dtype=int)), longest)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out`` of ``lang_pred`` and ``score``, replacing a column of that name.

    A null text and one without a letter are ``und`` with score 0.  Whole texts
    are read, of any length.  Texts are judged alone, so repeated rows get equal
    results.  An empty table gives no rows.
    """
    return docs.withColumn(out, model.column(F.col(f"`{text_col}`")))


@base.query("op7_language_id")
def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those of three folds out of four."""
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = base.held_out("doc_id", FOLDS, FOLD)
    model = fit_languages(docs.where(~held))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "language.lang_pred", "language.score")
