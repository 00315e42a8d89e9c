"""Best-fit packing with bounds: texts become token pieces, pieces become full sequences.

Pieces are dealt to partitions.  Each runs best-fit decreasing and certifies its
number of sequences by dual feasible functions of its lengths.  The certificate
is a fraction: a partition that is within one sequence of its bound cannot gain
alone, but with others it can.  So all partitions above the fraction give up
their sequences with free room; the documents in them are dealt anew to fewer
partitions and packed again, until a round saves nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from ..session import written
from .words import slices

CAPACITY, END_ID = 2048, 0
#: Pieces a partition packs, about.
PART_PIECES = 10_000


# -- tokens ------------------------------------------------------------------


def byte_of_character() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write bytes as."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """Text to ids for a vocabulary file, as ``tokenizers`` gives them by its defaults.

    A plain byte-level vocabulary in rank order is run by ``tiktoken``, which
    gives the same ids in a third of the time; any other by ``tokenizers``, and so
    are texts that hold the string of an added token, which is one id.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        return np.array(own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (
        model["type"] == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    )
    if plain:
        import tiktoken

        special = {t["content"] for t in spec.get("added_tokens", [])}
        byte = byte_of_character()
        ranks = {bytes(byte[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
        # contractions, letters, digits, marks and white space, each with one space before it
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: encode(text) if any(s in text for s in special) else fast.encode_to_numpy(text, disallowed_special=())
    return encode


def piece_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    for batch in batches:
        for part in slices(batch, "text"):
            row, piece, start, length, ids = [], [], [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                found = np.append(encode(text or ""), end_id).astype("<u4")
                n = len(found)
                cut = [0, *range(n % capacity or capacity, n, capacity), n]
                for k, (a, b) in enumerate(zip(cut, cut[1:])):
                    row.append(i), piece.append(k), start.append(a), length.append(b - a), ids.append(found[a:b].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
                ],
                names=["id", "piece", "start", "length", "ids"],
            )


def token_pieces(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """``id, piece, start, length, ids`` of every row; ``ids`` are little-endian unsigned 32-bit numbers.

    Each text's ids are followed by ``end_id``; null is an empty text.  The string
    of an added token in a text is that token, as ``tokenizers`` has it.  A text
    longer than ``capacity`` is cut into pieces of ``capacity``, the first of
    which may be shorter.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    make = partial(piece_batches, path=vocabulary, capacity=capacity, end_id=end_id)
    return rows.mapInArrow(make, "id long, piece int, start long, length long, ids binary")


# -- packing -----------------------------------------------------------------


def bound(lengths: np.ndarray, capacity: int) -> float:
    """A lower bound, as a fraction, by dual feasible functions.

    For each k up to half the capacity, lengths over capacity - k count as a whole
    bin and those under k as nothing; for each divisor d, lengths count as their
    share of 1 / d, rounded down to it from d + 1 times the length.  No packing
    has fewer bins than such a total of shares.
    """
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    count, total = np.cumsum(n), np.cumsum(n * size)
    k = np.arange(1, capacity // 2 + 1)
    whole = count[-1] - count[capacity - k]
    middle = total[capacity - k] - total[k - 1]
    best = max(total[-1] / capacity, float((whole + middle / capacity).max(initial=0)))
    for d in range(1, 20):
        share = (d + 1) * size
        exact = share % capacity == 0
        best = max(best, float((n * np.where(exact, size * d, share // capacity * capacity)).sum() / (capacity * d)))
    return best


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    return math.ceil(bound(lengths, capacity) - 1e-9)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every length by best-fit decreasing (ties in the given order), and the bins."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: dict[int, list[int]] = {}
    some, bins = 0, 0  # bit r of some: there is a bin with r free
    for i in order.tolist():
        need = int(lengths[i])
        fits = some >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            at, room, bins = bins, capacity, bins + 1
        where[i], offset[i] = at, capacity - room
        left = room - need
        if left:
            free.setdefault(left, []).append(at)
            some |= 1 << left
    return where, offset, bins


def pack_part(key, table: pa.Table, capacity: int) -> pa.Table:
    """One partition packed; ``open`` marks the pieces of the sequences it gives up."""
    table = table.sort_by([("length", "descending"), ("deal", "ascending")])
    lengths = table.column("length").to_numpy()
    where, offset, bins = best_fit(lengths, capacity)
    used = np.bincount(where, weights=lengths, minlength=bins).astype(np.int64)
    given = (used < capacity) & (bins > bound(lengths, capacity) + 1e-9)
    return pa.table(
        {
            "rest": table.column("rest").cast(base.loose(table.schema.field("rest").type)), "length": table.column("length"), "deal": table.column("deal"),
            "part": table.column("part"), "bin": pa.array(where), "offset": pa.array(offset),
            "open": pa.array(given[where]),
        }
    )


def pack_pieces(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """All columns of ``pieces`` with ``sequence_id`` and ``offset``: gapless from 0 in each sequence.

    Lengths are 1 to ``capacity``; longer, smaller or null ones are refused.
    Equal rows are different pieces.  An empty table gives no rows.  Columns of
    ``pieces`` named like the two are replaced.
    """
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    length = F.col(f"`{length_col}`").cast("long")
    sound = F.when(length.between(1, capacity), length).otherwise(F.raise_error(F.lit(f"a length is not 1 to {capacity}")).cast("long"))
    # a written random number spreads pieces however many of them are equal
    rows = written(
        pieces.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("rest"), sound.alias("length"), F.rand(7).alias("deal")), "pieces"
    )
    whole = rows.where(F.col("length") == capacity)
    todo, last, best = rows.where(F.col("length") < capacity), None, None
    done = [whole.select("rest", F.lit(0).alias("round"), F.lit(0).alias("part"), F.monotonically_increasing_id().alias("bin"), F.lit(0).cast("long").alias("offset"))]
    kind = rows.schema["rest"].dataType.simpleString()
    out = f"rest {kind}, length long, deal double, part int, bin long, offset long, open boolean"
    round_, n = 1, todo.count()
    while n:
        parts = -(-n // PART_PIECES)
        dealt = todo.withColumn("part", F.floor((F.col("deal") * round_ % 1) * parts).cast("int"))
        packed = written(dealt.groupBy("part").applyInArrow(base.grouped(partial(pack_part, capacity=capacity)), out), "packed")
        bins = packed.where("offset = 0").count()
        if last is not None and bins >= best:
            # nothing saved: what the round before had given up stays as it was
            done.append(last)
            break
        kept = packed.select("rest", F.lit(round_).alias("round"), "part", "bin", "offset", "open")
        done.append(kept.where("not open").drop("open"))
        last, todo = kept.where("open").drop("open"), packed.where("open").select("rest", "length", "deal")
        given = packed.where("open").agg(F.count("*"), F.count(F.when(F.col("offset") == 0, 1))).first()
        n, best = given[0], given[1]
        if parts == 1:
            done.append(last)
            break
        round_ += 1
    every = done[0]
    for more in done[1:]:
        every = every.unionAll(more)
    number = F.shiftleft(F.col("round").cast("long"), 56) + F.shiftleft(F.col("part").cast("long"), 32) + F.col("bin")
    number = F.when(F.col("round") == 0, F.col("bin")).otherwise(number)
    return every.select(number.alias("sequence_id"), "offset", "rest").select("rest.*", "sequence_id", "offset")


@base.query("op9_best_fit_packing")
def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    docs = base.table(spark, sf_dir, "documents")
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    pieces = pieces.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack_pieces(pieces)
