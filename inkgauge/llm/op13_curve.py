"""Packing along a space-filling curve: similar documents share sequences, none is padded.

A document's tokens make a hashed vector, which is projected to few dimensions;
the place of the projection on a Hilbert curve is its key.  Documents are sorted
in ranges of the key, laid end to end in that order and cut where a sequence is
full.  What is left at the end becomes sequences of powers of two, which need no
padding either.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base
from ..session import written
from .words import U, mix, slices

CAPACITY, END_ID = 2048, 1
#: Entries of a hashed vector, dimensions it is projected to, and bits of the curve a dimension.
ENTRIES, DIMENSIONS, BITS = 1 << 12, 4, 15
#: Standard deviations around the mean that the curve fills; what lies further out is at its edge.
SPAN = 4.0
#: Documents of a sorted range, about.
RANGE_ROWS = 100_000
#: A longer word is merged by ``tokenizers``, whose time grows less with its length.
LONG_WORD = 256

#: How the vocabulary files that are run word by word prepare a text.
END = "</w>"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Characters outside Latin letters (to U+017F) and general punctuation, and those whose case or kind engines see differently.
OTHER = re.compile("[\0\x1c-\x1fİ\u0180-\u1fff\u2070-\U0010ffff]")
#: The same pieces for the other characters: letters, one number, or marks.
LETTERS, NUMBERS = "a-zA-ZªµºÀ-ÖØ-öø-\u017f", "0-9²³¹¼-¾"
PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")


# -- tokens and vectors ------------------------------------------------------------


class Encoder:
    """Ids of texts as ``tokenizers`` gives them without special tokens.

    A vocabulary of lower-cased words, each merged by itself up to an end mark, is
    run word by word: different words are merged once a batch by ``tiktoken``, the
    mark as a zero byte behind the word.  That covers texts of Latin letters and
    general punctuation; others, and other vocabularies, are run by ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel part
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = None
        if spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER and spec["model"].get("end_of_word_suffix") == END:
            import tiktoken

            byte = byte_of_character()
            plain = {w: i for w, i in spec["model"]["vocab"].items() if w not in self.special}
            ranks = {bytes(byte[c] for c in w.removesuffix(END)) + b"\0" * w.endswith(END): i for w, i in plain.items()}
            self.fast = tiktoken.Encoding("own", pat_str="[^\0]*\0", mergeable_ranks=ranks, special_tokens={})
            self.ends = np.zeros(max(plain.values()) + 1, dtype=bool)
            self.ends[[i for w, i in plain.items() if w.endswith(END)]] = True

    def alone(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and where each word's end."""
        long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        short = words if not long else [w for w in words if len(w) <= LONG_WORD]
        ids = self.fast.encode_to_numpy("\0".join(short) + "\0", disallowed_special=()) if short else np.empty(0, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if not long:
            return ids, ends
        parts = iter(np.split(ids, ends[:-1]) if len(ends) else [])
        found = [self.alone(w) if len(w) > LONG_WORD else next(parts) for w in words]
        return np.concatenate(found), np.cumsum([len(f) for f in found])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        whole: dict[int, np.ndarray] = {}
        words: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if self.fast is None or OTHER.search(text) or any(s in text for s in self.special):
                whole[i] = self.alone(text)
            else:
                found = PIECE.findall(text.lower())
                counts[i] = len(found)
                words += found
        coded = pa.array(words, pa.string()).dictionary_encode()
        at = coded.indices.to_numpy()
        ids, ends = self.word_ids(coded.dictionary.to_pylist()) if len(words) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        sizes = np.diff(ends, prepend=0)[at]
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = ids[np.repeat((ends - np.diff(ends, prepend=0))[at] - before[:-1], sizes) + np.arange(before[-1])].astype("<u4")
        bounds = before[np.concatenate([[0], np.cumsum(counts)])]
        lengths = np.diff(bounds)
        if whole:
            lengths[list(whole)] = [len(x) for x in whole.values()]
            ids = np.concatenate([whole.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(texts))])
        return ids, lengths


def byte_of_character() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write bytes as."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def projection(entries: int, dimensions: int) -> np.ndarray:
    """A fixed matrix of signs."""
    bits = mix(np.arange(entries * dimensions, dtype=U) + U(0x51ED2701))
    return np.where(bits >> U(63), 1.0, -1.0).reshape(entries, dimensions)


def places(tokens: np.ndarray, lengths: np.ndarray, entries: int, dimensions: int) -> np.ndarray:
    """Each document's vector (logarithms of token counts by hashed entry, of length one) in few dimensions."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    entry = (mix(tokens.astype(U) + U(1)) % U(entries)).astype(np.int64)
    cell, count = np.unique(doc * entries + entry, return_counts=True)
    doc, entry = cell // entries, cell % entries
    weight = np.log1p(count)
    norm = np.sqrt(np.bincount(doc, weight * weight, len(lengths)))
    signs = projection(entries, dimensions)[entry] * weight[:, None]
    out = np.stack([np.bincount(doc, signs[:, k], len(lengths)) for k in range(dimensions)], axis=1)
    return out / np.maximum(norm, 1e-9)[:, None]


def token_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, entries: int, dimensions: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    for batch in batches:
        for part in slices(batch, "text"):
            tokens, n = encode([text or "" for text in part.column("text").to_pylist()])
            stop = np.cumsum(n)
            tokens, n = np.insert(tokens, stop, end_id), n + 1
            found = places(tokens, n, entries, dimensions)
            offsets = pa.array(np.concatenate([[0], np.cumsum(4 * n)]).astype(np.int32))
            ids = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets.buffers()[1], pa.py_buffer(tokens.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(n), ids, *[pa.array(found[:, k]) for k in range(dimensions)]],
                names=["id", "n", "ids", *[f"y{k}" for k in range(dimensions)]],
            )


# -- the curve -----------------------------------------------------------------------


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of grid cells (a row each), by undoing its turns bit by bit from the top."""
    x = [np.array(c, dtype=U) for c in cells.T]
    for bit in range(bits - 1, 0, -1):
        one, low = U(1 << bit), U((1 << bit) - 1)
        for i in range(len(x)):
            turned = (x[i] & one) != 0
            swap = np.where(turned, U(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), dtype=U)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & U(1 << bit), U((1 << bit) - 1), U(0))
    key = np.zeros(len(cells), dtype=U)
    for bit in range(bits - 1, -1, -1):
        for v in x:
            key = key << U(1) | (v ^ flip) >> U(bit) & U(1)
    return key


def key_batches(batches: Iterator[pa.RecordBatch], means: list[float], spreads: list[float], bits: int, span: float) -> Iterator[pa.RecordBatch]:
    """``uid, n, key``: every dimension is put on the grid by its mean and spread over all documents."""
    for batch in batches:
        y = np.stack([batch.column(f"y{k}").to_numpy(zero_copy_only=False) for k in range(len(means))], axis=1)
        unit = (y - np.array(means)) / (span * np.array(spreads))
        cells = np.clip(np.floor((unit + 1) / 2 * (1 << bits)), 0, (1 << bits) - 1)
        key = hilbert_key(cells.astype(np.int64), bits).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("n"), pa.array(key)], names=["uid", "n", "key"])


def sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``uid, part, n, start``: tokens of the rows before, in the order of the task's rows."""
    at = 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        ends = at + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("part"), batch.column("n"), pa.array(ends - n)], names=["uid", "part", "n", "start"])
        at = int(ends[-1]) if len(ends) else at


def along_curve(rows: DataFrame, range_rows: int = RANGE_ROWS, bits: int = BITS, span: float = SPAN) -> DataFrame:
    """``uid, at`` of written rows ``uid, n, y0, y1, ...``: the tokens before each on the curve.

    Rows are sorted in ranges of key and ``uid``, so copies of one document can fill
    many ranges; a total a range is what is summed up over all.
    """
    names = [c for c in rows.columns if re.fullmatch(r"y\d+", c)]
    stats = rows.agg(F.count("*"), *[F.avg(c) for c in names], *[F.stddev_pop(c) for c in names]).first()
    means, spreads = [v or 0.0 for v in stats[1 : len(names) + 1]], [v or 1.0 for v in stats[len(names) + 1 :]]
    make = partial(key_batches, means=means, spreads=spreads, bits=bits, span=span)
    keys = rows.select("uid", "n", *names).mapInArrow(make, "uid long, n long, key long")
    ranges = base.parts_for(stats[0], range_rows)
    order = keys.repartitionByRange(ranges, "key", "uid").sortWithinPartitions("key", "uid")
    sums = order.withColumn("part", F.spark_partition_id()).mapInArrow(sum_batches, "uid long, part int, n long, start long")
    sums = written(sums, "curve")
    totals = sums.groupBy("part").agg(F.sum("n").alias("tokens"))
    before = totals.select(F.col("part").alias("of"), (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))
    return sums.join(before, F.col("part") == F.col("of")).select("uid", (F.col("before") + F.col("start")).alias("at"))


# -- sequences -----------------------------------------------------------------------


def last_cuts(total: int, capacity: int) -> list[int]:
    """Where sequences begin after the last full one, and the end: each a power of two long, the longest first."""
    at = total - total % capacity
    out = [at]
    for bit in range(capacity.bit_length() - 1, -1, -1):
        if total % capacity >> bit & 1:
            at += 1 << bit
            out.append(at)
    return out


def cut(at: int, n: int, total: int, capacity: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of ``n`` tokens that begin at ``at`` of ``total``."""
    last = last_cuts(total, capacity)
    full = last[0]
    out, here = [], at
    while here < at + n:
        if here < full:
            sequence, begin = divmod(here, capacity)
            offset, stop = begin, here - begin + capacity
        else:
            k = int(np.searchsorted(last, here, "right")) - 1
            sequence, offset, stop = full // capacity + k, here - last[k], last[k + 1]
        stop = min(stop, at + n)
        out.append((here - at, stop - here, sequence, offset))
        here = stop
    return out


def piece_batches(batches: Iterator[pa.RecordBatch], total: int, capacity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, found, ids = [], [], []
        for i, (data, at) in enumerate(zip(batch.column("ids").to_pylist(), batch.column("at").to_pylist())):
            for piece in cut(at, len(data) // 4, total, capacity):
                row.append(i), found.append(piece), ids.append(data[4 * piece[0] : 4 * (piece[0] + piece[1])])
        numbers = np.array(found, dtype=np.int64).reshape(-1, 4)
        rows = pa.array(row, pa.int64())
        columns = [batch.column("id").take(rows), *[pa.array(numbers[:, k]) for k in (0, 1)], pa.array(ids, pa.binary()), batch.column("n").take(rows), *[pa.array(numbers[:, k]) for k in (2, 3)]]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def curve_sequences(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    entries: int = ENTRIES, dimensions: int = DIMENSIONS,
) -> DataFrame:
    """``id, start, length, ids, doc_tokens, sequence_id, offset`` of the pieces of every row.

    ``ids`` are little-endian unsigned 32-bit numbers; a text's ids are followed by
    ``end_id``.  Null and empty texts are that id alone.  A text of any length is
    whole, over as many sequences as it takes.  Rows count each, whether their ids
    are null, repeat or their texts are equal; equal texts lie next to each other.
    Sequences are numbered along the curve from 0; ``capacity``, a power of two, is
    their length, and the last tokens of the table fill sequences of smaller powers
    of two.  An empty table gives no rows.  Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    make = partial(token_batches, path=vocabulary, end_id=end_id, entries=entries, dimensions=dimensions)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n long, ids binary, " + ", ".join(f"y{k} double" for k in range(dimensions))
    tokens = written(rows.mapInArrow(make, schema).withColumn("uid", F.monotonically_increasing_id()), "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    order = along_curve(tokens.drop("id", "ids"))
    pieces = partial(piece_batches, total=total, capacity=capacity)
    out = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return tokens.select("uid", "id", "n", "ids").join(order, "uid").select("id", "n", "ids", "at").mapInArrow(pieces, out)


@base.query("op13_curve_packing")
def op13_curve_packing(spark, sf_dir: str) -> DataFrame:
    """All documents along the curve in sequences of 2048 tokens."""
    import public_tokenizers

    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = curve_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
