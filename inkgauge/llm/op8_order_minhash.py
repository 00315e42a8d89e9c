"""Near-duplicates by order MinHash, verified by banded alignment.

A sketch entry hashes all shingles of five words, each labelled with its number
of occurrence, takes the ``picks`` smallest and keeps their order in the text.
Texts that share an entry are compared; two are linked if an alignment of their
shingles, banded to what the threshold allows, keeps at least ``threshold`` of
all shingles of both: kept / (n + m - kept).  Classes are the connected texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from ..session import written
from .components import components
from .words import U, Words, mix, slices

SHINGLE, THRESHOLD = 5, 0.8
#: With 16 entries of 3 shingles a pair of similarity 0.8 shares none with a chance of about 1e-5.
ENTRIES, PICKS = 16, 3
#: In a bucket of at most so many texts all are compared; beyond, with its leaders, and all that this leaves apart by ``exact_pairs``.
SMALL = 8
#: Slots in which the texts of a shingle are counted, and texts of one shingle that are compared by one part.
SLOTS, PART = 1 << 20, 512
MARKS = [f"m{k}" for k in range(8)]
TOP = U(2**64 - 1)


def occurrences(values: np.ndarray) -> np.ndarray:
    """Number of equal values before each one."""
    at = np.argsort(values, kind="stable")
    sorted_ = values[at]
    new = np.ones(len(values), dtype=bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    first = np.flatnonzero(new)
    out = np.empty(len(values), dtype=np.int64)
    out[at] = np.arange(len(values)) - np.repeat(first, np.diff(np.append(first, len(values))))
    return out


def sketches(words: Words, shingle: int, entries: int, picks: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the texts that have a shingle, and their entries."""
    hashes, same = words.windows(shingle)
    hashes, doc = hashes[same], words.doc[: len(same)][same]
    rows, begin, count = np.unique(doc, return_index=True, return_counts=True)
    out = np.empty((len(rows), entries), dtype=U)
    if not len(rows):
        return rows, out
    label = occurrences(hashes ^ mix(doc.astype(U) + U(1)))
    named = mix(hashes + label.astype(U) * U(0x9E3779B97F4A7C15))
    for j in range(entries):
        order = named ^ U((j + 1) * 0xD6E8FEB86659FD93 % 2**64)
        order = order * U(0xFF51AFD7ED558CCD)
        order ^= order >> U(32)
        place = np.empty((picks, len(rows)), dtype=np.int64)
        for k in range(picks):
            least = np.minimum.reduceat(order, begin)
            at = np.flatnonzero(order == np.repeat(least, count))
            first = np.searchsorted(at, begin)  # leftmost of ties
            place[k] = at[first]
            order[place[k]] = TOP
        place.sort(axis=0)
        entry = np.full(len(rows), j + 1, dtype=U)
        for k in range(picks):
            entry = mix(entry * U(0x9E3779B97F4A7C15) + hashes[place[k]])
        out[:, j] = entry
    return rows, out


def sketch_batches(batches: Iterator[pa.RecordBatch], shingle: int, entries: int, picks: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            # the sequence of words as two sums of hashes of word and place
            place = np.arange(len(words), dtype=np.int64) - words.begin[words.doc]
            sums = []
            for seed in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
                total = np.concatenate([[U(0)], np.cumsum(mix(words.hash ^ mix(place.astype(U) + U(seed))), dtype=U)])
                sums.append((total[words.begin[1:]] - total[words.begin[:-1]]).view(np.int64))
            rows, found = sketches(words, shingle, entries, picks)
            has = np.zeros(words.docs, dtype=bool)
            has[rows] = True
            offsets = np.concatenate([[0], np.cumsum(has * entries)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array(sums[0]),
                    pa.array(sums[1]),
                    pa.array(words.counts.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.view(np.int64).ravel())),
                ],
                names=["id", "sig", "sig2", "n_words", "entries"],
            )


def kept_in_band(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Most pairs of equal values in order, no further than ``band`` places apart.

    One bit for each place of ``a``: the bits of places that end a longer common
    subsequence are cleared value by value of ``b``.
    """
    n = min(len(a), len(b))
    head = int(np.argmin(np.append(a[:n] == b[:n], False)))
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    tail = int(np.argmin(np.append(a[::-1][:n] == b[::-1][:n], False)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    every = (1 << len(a)) - 1
    strip = (1 << (2 * band + 1)) - 1
    row = every
    for j, y in enumerate(b.tolist()):
        hit = where.get(y)
        if hit is None:
            continue
        hit &= (strip << (j - band)) if j >= band else (strip >> (band - j))
        if hit:
            use = row & hit
            row = ((row + use) | (row - use)) & every
    return head + tail + len(a) - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Shingles kept by the banded alignment over all of both; 0 where the lengths alone forbid the threshold."""
    need = math.ceil(threshold * (len(a) + len(b)) / (1 + threshold) - 1e-9)
    if not need or need > min(len(a), len(b)):
        return 0.0
    kept = kept_in_band(a, b, max(len(a), len(b)) - need)
    return kept / (len(a) + len(b) - kept)


def verify_batches(batches: Iterator[pa.RecordBatch], shingle: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text_a"):
            sides = []
            for name in ("text_a", "text_b"):
                words = Words(part.column(name))
                hashes, _ = words.windows(shingle)
                ends = [(int(s), max(int(s), int(e) - shingle + 1)) for s, e in zip(words.begin, words.begin[1:])]
                sides.append([hashes[s:e] for s, e in ends])
            found = np.array([similarity(a, b, threshold) for a, b in zip(*sides)], dtype=float)
            yield pa.RecordBatch.from_arrays(
                [part.column("a").filter(pa.array(found >= threshold)), part.column("b").filter(pa.array(found >= threshold)), pa.array(found[found >= threshold])],
                names=["a", "b", "similarity"],
            )


def bucket_pairs(members: DataFrame) -> DataFrame:
    """Pairs ``a < b`` to compare among ``entry, id``, each once.

    Every text is compared with the smallest and the largest id of its bucket; in
    small buckets all with all, so a bucket adds a few rows a member at most.
    """
    buckets = members.groupBy("entry").agg(F.count("*").alias("size"), F.min("id").alias("low"), F.max("id").alias("high"))
    rows = members.join(buckets.where("size > 1"), "entry")
    star = rows.select("id", F.explode(F.array("low", "high")).alias("with")).where("id <> with")
    star = star.select(F.least("id", "with").alias("a"), F.greatest("id", "with").alias("b"))
    little = rows.where(F.col("size").between(3, SMALL)).select("entry", "id")
    every = (
        little.alias("x")
        .join(little.alias("y"), "entry")
        .where("x.id < y.id")
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    )
    return star.unionAll(every).distinct()


def with_classes(members: DataFrame, classes: DataFrame) -> DataFrame:
    return members.join(classes.withColumnRenamed("node", "id"), "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))


def unresolved(known: DataFrame) -> DataFrame:
    """The rows ``id, entry, class_id`` of large buckets that hold more than one class so far, with the ``size`` of the bucket."""
    mixed = known.groupBy("entry").agg(F.count("*").alias("size"), F.min("class_id").alias("low"), F.max("class_id").alias("high"))
    mixed = mixed.where((F.col("size") > SMALL) & (F.col("low") < F.col("high"))).select("entry", "size")
    return known.join(mixed, "entry")


def typical_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of each text with the text of its bucket that shares most with others, where their classes differ.

    The sizes of a text's buckets tell how usual its entries are: the base of a
    group of edited copies is in the large bucket of every entry.
    """
    weight = rows.groupBy("id").agg(F.sum("size").alias("weight"))
    best = rows.join(weight, "id").groupBy("entry").agg(F.max(F.struct("weight", F.col("id").alias("with"), F.col("class_id").alias("other"))).alias("best"))
    star = rows.join(best, "entry").where("class_id <> best.other").select("id", F.col("best.with").alias("with"))
    return star.select(F.least("id", "with").alias("a"), F.greatest("id", "with").alias("b")).distinct()


# -- the exact way -----------------------------------------------------------


def labelled(part: pa.RecordBatch, shingle: int) -> list[np.ndarray]:
    """The shingles of every text, each with its number of occurrence in one hash; all of a text differ."""
    words = Words(part.column("text"))
    hashes, same = words.windows(shingle)
    hashes, doc = hashes[same], words.doc[: len(same)][same]
    named = mix(hashes + occurrences(hashes ^ mix(doc.astype(U) + U(1))).astype(U) * U(0x9E3779B97F4A7C15))
    ends = np.searchsorted(doc, np.arange(words.docs + 1))
    return [named[s:e] for s, e in zip(ends, ends[1:])]


def slot_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """How many texts of the task have a shingle of each slot."""
    total = np.zeros(SLOTS, dtype=np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            for found in labelled(part, shingle):
                np.add.at(total, (found % U(SLOTS)).astype(np.int64), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "texts"])


def prefix_batches(batches: Iterator[pa.RecordBatch], shingle: int, threshold: float, usual: bytes) -> Iterator[pa.RecordBatch]:
    """Each text's rarest shingles, so many that two texts at the threshold share one, and the parity of all of them in 512 bits."""
    rank = np.frombuffer(usual, dtype=np.uint8)
    for batch in batches:
        for part in slices(batch, "text", 1_000_000):
            row, keys, before, places, sizes, bits = [], [], [], [], [], []
            for i, found in enumerate(labelled(part, shingle)):
                n = len(found)
                if not n:
                    continue
                order = np.lexsort((found, rank[(found % U(SLOTS)).astype(np.int64)]))
                take = n - math.ceil(threshold * n - 1e-9) + 1
                rare = found[order[:take]]
                row.append(np.full(take, i)), keys.append(rare), before.append(np.append(rare[:1], rare[:-1])), places.append(np.arange(take)), sizes.append(n)
                parity = np.bincount((mix(found) >> U(55)).astype(np.int64), minlength=512) & 1
                bits.append(np.packbits(parity.astype(np.uint8)).view(np.int64))
            if not row:
                continue
            times = [len(r) for r in row]
            at = pa.array(np.concatenate(row))
            marks = np.repeat(np.array(bits), times, axis=0)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(at), part.column("class_id").take(at), pa.array(np.concatenate(keys).view(np.int64)),
                    pa.array(np.concatenate(before).view(np.int64)), pa.array(np.concatenate(places)), pa.array(np.repeat(np.array(sizes, dtype=np.int64), times)),
                    *[pa.array(np.ascontiguousarray(marks[:, k])) for k in range(8)],
                ],
                names=["id", "class_id", "key", "before", "place", "n", *MARKS],
            )


def shared_needed(n, m, threshold: float):
    """Shingles that texts of ``n`` and ``m`` of them share at the threshold."""
    return F.ceil(threshold * (n + m) / (1 + threshold) - 1e-9)


def meetings(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a < b`` of different classes, once for each key where they can meet first.

    All that two texts share comes at or after the first shingle they share, in the
    order of all texts.  At that one, with ``place`` shingles before it, a text of n
    has n - place left, which must be as many as the threshold needs; the shingles
    before it are in one text alone, and so are those that their parities differ
    by.  So the copies around a base do not meet in the base's shingles, where
    their own edits come before; they meet in edits they share.  Where both have the
    same shingle before this one, they have met there.
    """
    keys = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("class_id").alias("low"), F.max("class_id").alias("high"), F.min("n").alias("least"))
    rows = rows.join(keys.where("low < high").select("key", "least", F.ceil(F.col("size") / PART).alias("parts")), "key")
    rows = rows.where(F.col("n") - F.col("place") >= shared_needed(F.col("n"), F.col("least"), threshold)).drop("least")
    x = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts").alias("x")
    y = rows.withColumn("part", F.pmod(F.xxhash64("id"), "parts")).drop("parts").alias("y")
    need = shared_needed(F.col("x.n"), F.col("y.n"), threshold)
    apart = F.col("x.n") + F.col("y.n") - 2 * need
    differ = sum((F.bit_count(F.col(f"x.{m}").bitwiseXOR(F.col(f"y.{m}"))) for m in MARKS), F.lit(0))
    first = (F.col("x.n") - F.col("x.place") >= need) & (F.col("y.n") - F.col("y.place") >= need) & (F.col("x.place") + F.col("y.place") <= apart)
    first = first & ((F.col("x.before") != F.col("y.before")) | (F.least("x.place", "y.place") == 0))
    near = (F.col("x.id") < F.col("y.id")) & (F.col("x.class_id") != F.col("y.class_id")) & first & (differ <= apart)
    both = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & near)
    return both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def rarest(texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Rows ``id, class_id, key, before, place, n`` and parities: the rarest shingles of ``id, class_id, text``.

    The order comes from counts in a fixed number of slots, ties by the shingle.
    """
    slots = texts.select("text").mapInArrow(partial(slot_batches, shingle=shingle), "slot long, texts long")
    counts = slots.groupBy("slot").agg(F.sum("texts").alias("texts")).where("texts > 1")
    counts = counts.select(F.col("slot").cast("int").alias("slot"), F.least(F.lit(255), F.floor(8 * F.log2("texts"))).cast("short").alias("rank")).toArrow()
    usual = np.zeros(SLOTS, dtype=np.uint8)
    usual[counts.column("slot").to_numpy()] = counts.column("rank").to_numpy()
    make = partial(prefix_batches, shingle=shingle, threshold=threshold, usual=usual.tobytes())
    schema = "id long, class_id long, key long, before long, place long, n long, " + ", ".join(f"{m} long" for m in MARKS)
    return texts.select("id", "class_id", "text").mapInArrow(make, schema)


def exact_pairs(texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """All pairs of ``id, class_id, text`` of different classes that can reach the threshold, and few others.

    Such texts share one of their rarest shingles in any order that is the same
    for all texts, have similar lengths, and meet as ``meetings`` says.  None of
    this loses a pair.  A shingle of many texts is dealt to parts, so no task holds
    all of its pairs.
    """
    return meetings(written(rarest(texts, shingle, threshold), "prefixes"), threshold).distinct()


def joined(classes: DataFrame, known: DataFrame, links: DataFrame) -> DataFrame:
    """The classes with those that ``links`` between texts of ``known`` connect made one."""
    of = known.select("id", "class_id").distinct()
    ends = links.join(of.select(F.col("id").alias("a"), F.col("class_id").alias("x")), "a").join(of.select(F.col("id").alias("b"), F.col("class_id").alias("y")), "b")
    merged = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("was"), F.col("class_id").alias("now"))
    more = ends.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    every = classes.unionAll(more.join(classes, "node", "left_anti").select("node", F.col("node").alias("class_id")))
    return written(every.join(merged, every.class_id == merged.was, "left").select("node", F.coalesce("now", "class_id").alias("class_id")), "classes")


def linked(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs whose texts reach the threshold, with their ``similarity``."""
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(partial(verify_batches, shingle=shingle, threshold=threshold), "a long, b long, similarity double")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
    shingle: int = SHINGLE, entries: int = ENTRIES, picks: int = PICKS,
) -> DataFrame:
    """``id, class_id, n_words`` of every row; the class is the smallest id of its group.

    Texts of the same words are one text and in one class.  Texts of fewer words
    than a shingle are only in a class with equal ones.  Null, empty and blank
    texts are alone, and so are rows of a null id (their class is null).  Rows of
    one id count as one document.  Texts of any length are compared whole.  Only the
    two named columns are read, so others may have any name.  An empty table gives no
    rows.  In a bucket of
    more than ``SMALL`` texts each is compared with the smallest and the largest
    id; if that leaves more than one class, with the text that shares most with
    others, and if that does too, every pair of its texts that are of different
    classes and can reach the threshold is compared.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    make = partial(sketch_batches, shingle=shingle, entries=entries, picks=picks)
    table = written(texts.mapInArrow(make, "id long, sig long, sig2 long, n_words long, entries array<long>"), "sketches")
    known = table.where("id is not null and n_words > 0")
    # the first of the texts of each sequence of words, found in one pass; each row's is looked up once
    first = known.groupBy("sig", "sig2").agg(F.min(F.struct("id", "entries")).alias("first"))
    firsts = written(first.select("sig", "sig2", "first.*"), "distinct-texts")
    reps = firsts.where(F.size("entries") > 0)
    copies = known.select("id", "sig", "sig2").join(firsts.select("sig", "sig2", F.col("id").alias("rep")), ["sig", "sig2"])
    copies = written(copies.select("id", "rep"), "copies")
    members = reps.select("id", F.explode("entries").alias("entry"))
    links = written(linked(written(bucket_pairs(members), "pairs"), texts, shingle, threshold), "links").select("a", "b")
    # rows of one id are one document
    several = copies.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("id", "a")
    links = links.unionAll(copies.join(several, "id").where("a <> rep").select("a", F.col("rep").alias("b")))
    classes = components(links)
    # where not all were compared with all: the most usual text of a bucket first, then every pair that can be near
    for exact in (False, True):
        rows = written(unresolved(with_classes(members, classes)), "unresolved")
        if rows.isEmpty():
            break
        pairs = typical_pairs(rows)
        if exact:
            pairs = exact_pairs(written(texts.join(rows.select("id", "class_id").distinct(), "id"), "unresolved-texts"), shingle, threshold)
        more = written(linked(written(pairs, "pairs"), texts, shingle, threshold), "links").select("a", "b")
        classes = joined(classes, rows, more)
    found = (
        copies.join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .groupBy("id")
        .agg(F.min(F.coalesce("class_id", "rep")).alias("class_id"))
    )
    out = table.select("id", "n_words").join(found, "id", "left")
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), "n_words")


@base.query("op8_order_minhash")
def op8_order_minhash(spark, sf_dir: str) -> DataFrame:
    """Class of every document of the whole table."""
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_words", (F.col("id") == F.col("class_id")).alias("kept"))
