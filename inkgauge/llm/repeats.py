"""Passages of a fixed number of words that an earlier document has too.

Both operators on such passages run these steps, each a Spark stage:

1. texts are dealt to chunks by their id (one shuffle of the texts, reused by
   steps 3 and 5); a chunk names its *anchors*, each distinct one once,
2. anchors meet by their fingerprint and those of two chunks come back,
3. a chunk extends the places of shared anchors, left and right, to all windows
   around them and names each distinct one with its smallest document,
4. windows meet by their fingerprint; the smallest document comes back,
5. a chunk marks the windows that a smaller document has and cuts their words.

A chunk names an anchor or window once, however many of its documents have it,
so a passage of a third of all documents is as many rows as there are chunks.
Nothing is capped and no pair of documents is made.  Windows are compared by a
64-bit fingerprint: among n candidate windows the chance of one false match is
about n*n / 2**65.

Null ids count as larger than all others, and rows of the same id never remove
each other's words.  Null, empty and blank texts have no words.  Columns other
than id and text pass through in the struct ``rest``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .words import U, Words, covered, pack, runs, unpack

#: Bytes of an anchor's fingerprint besides its bucket number.
ANCHOR_BYTES = 5
#: Anchors or windows that meet in a task, about.
BUCKET_KEYS = 2_500_000
#: Code points a word takes at least, on average, with its space: for the number of buckets only.
CHARS_PER_WORD = 5
NULL_ID = np.iinfo(np.int64).max

PACKED = "bucket int, chunk int, keys binary, marks binary"
FOUND = "chunk int, keys binary, marks binary"

#: Of the words of a chunk: hash at each place, whether it is an anchor, and whether an anchor of
#: another document can be found by it.
Anchors = Callable[[Words], tuple[np.ndarray, np.ndarray, np.ndarray]]


def ids_of(table: pa.Table) -> np.ndarray:
    ids = table.column("id").combine_chunks()
    return ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def one_array(table: pa.Table, name: str) -> pa.Array:
    col = table.column(name)
    return pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)


def first_per_key(keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the smallest ``order`` of each."""
    at = np.lexsort((order, keys))
    keys, order = keys[at], order[at]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new], order[new]


def in_sorted(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is among the sorted ones, and where."""
    if not len(among):
        return np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=np.int64)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values, at


def bucketed(keys: np.ndarray, buckets: int, shift: int) -> np.ndarray:
    """Bucket number above the low ``shift`` bits of a hash."""
    return (((keys >> U(40)) % U(buckets)) << U(shift)) | (keys & U((1 << shift) - 1))


def rows_by_bucket(bucket: np.ndarray, chunk: int, columns: list[tuple[np.ndarray, int | None]]) -> pa.Table:
    """A row for each bucket; ``bucket`` is sorted."""
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, int)
    stop = np.append(edge[1:], len(bucket))
    packed = [
        [np.packbits(v[a:b]).tobytes() if width is None else pack(v[a:b], width) for a, b in zip(edge, stop)]
        for v, width in columns
    ]
    return pa.table(
        [pa.array(bucket[edge].astype(np.int32)), pa.array(np.full(len(edge), chunk, np.int32)), *[pa.array(x, pa.binary()) for x in packed]],
        names=["bucket", "chunk", "keys", "marks"],
    )


class Repeats:
    """The five steps for one choice of anchors."""

    def __init__(self, anchors: Anchors, window: int, before: int, buckets: int, join_words: bool):
        # a window holds an anchor at one of its first ``before`` + 1 places
        self.anchors, self.window, self.before, self.buckets, self.join_words = anchors, window, before, buckets, join_words

    # -- step 1 and 2
    def name_anchors(self, key, table: pa.Table) -> pa.Table:
        words = Words(one_array(table, "text"))
        hashes, probe, block = self.anchors(words)
        keys = bucketed(hashes, self.buckets, 8 * ANCHOR_BYTES)
        named = np.unique(keys[probe])
        marks, _ = in_sorted(named, np.unique(keys[block]))
        return rows_by_bucket(named >> U(8 * ANCHOR_BYTES), key[0].as_py(), [(named, ANCHOR_BYTES), (marks, None)])

    @staticmethod
    def meet_anchors(key, table: pa.Table) -> pa.Table:
        """Anchors of two or more chunks that one of them has as a block."""
        chunk, keys, marks = [], [], []
        for c, k, m in zip(*(table.column(n).to_pylist() for n in ("chunk", "keys", "marks"))):
            k = unpack(k, ANCHOR_BYTES)
            keys.append(k)
            marks.append(np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)).astype(bool))
            chunk.append(np.full(len(k), c, np.int32))
        chunk, keys, marks = np.concatenate(chunk), np.concatenate(keys), np.concatenate(marks)
        at = np.argsort(keys, kind="stable")
        chunk, keys, marks = chunk[at], keys[at], marks[at]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(edge, len(keys)))
        shared = np.repeat((size > 1) & np.logical_or.reduceat(marks, edge), size)
        chunk, keys = chunk[shared], keys[shared] | (U(key[0].as_py()) << U(8 * ANCHOR_BYTES))
        at = np.argsort(chunk, kind="stable")
        return found_rows(chunk[at], [(keys[at], 8), (None, 0)])

    # -- step 3 and 4
    def name_windows(self, key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return rows_by_bucket(np.empty(0, U), 0, [(np.empty(0, U), 8), (np.empty(0, U), 8)])
        words, ids = Words(one_array(docs, "text")), ids_of(docs)
        hashes, probe, block = self.anchors(words)
        keys = bucketed(hashes, self.buckets, 8 * ANCHOR_BYTES)
        # anchors that documents of this chunk share among themselves
        own, doc = keys[probe], words.doc[: len(keys)][probe]
        at = np.argsort(own, kind="stable")
        own, doc = own[at], doc[at]
        other = np.flatnonzero((own[1:] == own[:-1]) & (ids[doc[1:]] != ids[doc[:-1]]))
        local = np.unique(own[other])
        local = local[in_sorted(local, np.unique(keys[block]))[0]]
        shared = np.unique(np.concatenate([local, *[unpack(k, 8) for k in answers.column("keys").to_pylist()]]))
        hit = np.zeros(len(words) + 1, dtype=np.int64)
        hit[1 : len(keys) + 1] = probe & in_sorted(keys, shared)[0]
        sums = np.cumsum(hit)
        prints, same = words.windows(self.window)
        n = len(prints)
        near = sums[np.minimum(np.arange(n) + self.before + 1, len(words))] - sums[:n] > 0
        cand = np.flatnonzero(same & near)
        named, first = first_per_key(prints[cand], ids[words.doc[cand]])
        bucket = named % U(self.buckets)
        at = np.argsort(bucket, kind="stable")
        return rows_by_bucket(bucket[at], key[0].as_py(), [(named[at], 8), (first[at].view(U), 8)])

    @staticmethod
    def meet_windows(key, table: pa.Table) -> pa.Table:
        """To each chunk the windows that a smaller document of another chunk has, with that document."""
        chunk, keys, first = [], [], []
        for c, k, m in zip(*(table.column(n).to_pylist() for n in ("chunk", "keys", "marks"))):
            keys.append(np.frombuffer(k, "<u8"))
            first.append(np.frombuffer(m, "<i8"))
            chunk.append(np.full(len(keys[-1]), c, np.int32))
        chunk, keys, first = np.concatenate(chunk), np.concatenate(keys), np.concatenate(first)
        at = np.lexsort((first, keys))
        chunk, keys, first = chunk[at], keys[at], first[at]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        least = np.repeat(first[edge], np.diff(np.append(edge, len(keys))))
        later = first > least
        chunk, keys, least = chunk[later], keys[later], least[later]
        at = np.argsort(chunk, kind="stable")
        return found_rows(chunk[at], [(keys[at], 8), (least[at].view(U), 8)])

    # -- step 5
    def cut(self, key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        words, ids = Words(one_array(docs, "text")), ids_of(docs)
        prints, same = words.windows(self.window)
        place = np.flatnonzero(same)
        named, first = first_per_key(prints[place], ids[words.doc[place]])
        if answers.num_rows:
            keys, least = first_per_key(
                np.concatenate([unpack(k, 8) for k in answers.column("keys").to_pylist()]),
                np.concatenate([np.frombuffer(m, "<i8") for m in answers.column("marks").to_pylist()]),
            )
            known, at = in_sorted(named, keys)
            first = np.where(known, np.minimum(first, least[at]), first)
        at = np.searchsorted(named, prints[place])
        gone = covered(place[first[at] < ids[words.doc[place]]], self.window, len(words))
        removed = np.bincount(words.doc[gone], minlength=words.docs)
        kept, spans = [], []
        data = words.data.tobytes()
        for d in range(words.docs):
            a, b = int(words.begin[d]), int(words.begin[d + 1])
            if not removed[d]:
                whole = data[words.offsets[d] : words.offsets[d + 1]]
                kept.append(b" ".join(whole.split()) if self.join_words else whole)
                spans.append([])
                continue
            lo, hi = runs(gone[a:b])
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(lo, hi)])
            lo, hi = runs(~gone[a:b])
            left = [data[words.start[x] : words.end[y - 1]] for x, y in zip(lo + a, hi + a)]
            kept.append(b" ".join(w for part in left for w in part.split()) if self.join_words else b" ".join(left))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                "id": docs.column("id"),
                "n_words": pa.array(words.counts.astype(np.int64)),
                "n_removed": pa.array(removed.astype(np.int64)),
                "spans": pa.array(spans, kind),
                "kept_text": pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()),
                "rest": docs.column("rest").cast(base.loose(docs.schema.field("rest").type)),
            }
        )


def found_rows(chunk: np.ndarray, columns: list[tuple[np.ndarray | None, int]]) -> pa.Table:
    edge = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(chunk) else np.empty(0, int)
    stop = np.append(edge[1:], len(chunk))
    cols = [pa.array([b"" if v is None else pack(v[a:b], w) for a, b in zip(edge, stop)], pa.binary()) for v, w in columns]
    return pa.table([pa.array(chunk[edge].astype(np.int32)), *cols], names=["chunk", "keys", "marks"])


def remove_repeats(
    docs: DataFrame, id_col: str, text_col: str, anchors: Anchors, window: int, before: int, probes_per_word: float, join_words: bool
) -> DataFrame:
    """``id, n_words, n_removed, spans, kept_text, rest`` of every row.

    ``spans`` are the removed word ranges [start, end); ``kept_text`` joins the
    other words by one space, or without ``join_words`` the text between the
    spans as it stands.
    """
    chars = base.total_chars(docs, text_col)
    chunks = base.parts_for(chars, base.CHUNK_CHARS)
    buckets = base.parts_for(chars / CHARS_PER_WORD * probes_per_word, BUCKET_KEYS)
    steps = Repeats(anchors, window, before, buckets, join_words)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), rest.alias("rest")
    )
    # null ids are spread by their text
    rows = rows.withColumn("chunk", base.hash_part(F.coalesce(F.col("id"), F.xxhash64("text")), chunks))
    dealt = rows.groupBy("chunk")
    named = dealt.applyInArrow(base.grouped(steps.name_anchors), PACKED)
    shared = named.groupBy("bucket").applyInArrow(base.grouped(steps.meet_anchors), FOUND)
    near = dealt.cogroup(shared.groupBy("chunk")).applyInArrow(base.cogrouped(steps.name_windows), PACKED)
    earlier = near.groupBy("bucket").applyInArrow(base.grouped(steps.meet_windows), FOUND)
    out = f"id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string, rest {rows.schema['rest'].dataType.simpleString()}"
    return dealt.cogroup(earlier.groupBy("chunk")).applyInArrow(base.cogrouped(steps.cut), out)
