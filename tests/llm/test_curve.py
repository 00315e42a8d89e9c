import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkgauge.llm import op13_curve as o

from .helpers import odd_documents, sentence

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


def ids_of(text, end=1):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("dimensions,bits", [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_next_to_the_last(dimensions, bits):
    side = 1 << bits
    cells = np.array(np.meshgrid(*[np.arange(side)] * dimensions)).reshape(dimensions, -1).T
    key = o.hilbert_key(cells, bits)
    assert sorted(key.tolist()) == list(range(side**dimensions))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("total", [0, 1, 7, 16, 61, 64])
def test_cuts_fill_sequences(total):
    rng, at, seen = random.Random(total), 0, {}
    while at < total:
        n = min(rng.randint(1, 40), total - at)
        pieces = o.cut(at, n, total, 16)
        assert [p[0] for p in pieces] == list(np.cumsum([0] + [p[1] for p in pieces])[:-1]) and sum(p[1] for p in pieces) == n
        for start, length, sequence, offset in pieces:
            assert seen.get(sequence, 0) == offset
            seen[sequence] = offset + length
        at += n
    assert sum(seen.values()) == total and sorted(seen) == list(range(len(seen)))
    assert all(n == 16 or n & (n - 1) == 0 for n in seen.values()) and sum(n < 16 for n in seen.values()) <= 4


def test_ids_are_those_of_the_tokenizer():
    rng = random.Random(2)
    own, encode = Tokenizer.from_file(PATH), o.Encoder(PATH)
    assert encode.fast is not None and o.Encoder(public_tokenizers.path("byte_bpe_50k.json")).fast is None
    odd = list("aB'sé ß̸́ \t\n\r\x0b\x0c\x1c\x85\xa0 　ΣΑςİǅ漢ﬁ🙂‍12٣#<|>-’“–\0") + ["<|endoftext|>", "<|startoftext|>", "'ll", "Don't", "é", "\r\n", "hello", "World "]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    # every character that is run word by word, between letters, numbers, marks and spaces
    plain = [chr(c) for c in [*range(0x180), *range(0x2000, 0x2070)] if not o.OTHER.match(chr(c))]
    texts += [f"a{c}b 1{c}{c}2 '{c} {c}'s {c}" for c in plain] + ["".join(rng.choice(plain) for _ in range(60)) for _ in range(500)]
    texts += ["", "x" * 5000 + " y " + "#" * 300, "z", "ab" * 200 + "'s", "\0"]
    assert sum(not o.OTHER.search(t) for t in texts) > 1000
    for data in (texts, [], [""], texts[-5:]):
        ids, lengths = encode(data)
        assert lengths.sum() == len(ids) and len(lengths) == len(data)
        for text, got in zip(data, np.split(ids, np.cumsum(lengths)[:-1]) if data else []):
            assert got.tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_vocabularies_are_run_by_tokenizers(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = Tokenizer.from_file(path).encode("Some words, 12 of them").ids + [0]
    rows = o.curve_sequences(odd_documents(spark, [(1, "Some words, 12 of them")]), path, end_id=0).collect()
    assert np.frombuffer(b"".join(r.ids for r in sorted(rows, key=lambda r: r.start)), "<u4").tolist() == ids


def whole(rows):
    """Sequences without gaps, and each document's pieces put together: (id, ids) of all rows."""
    by_sequence, docs = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by_sequence.values():
        x.sort()
        assert [a for a, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))]
    return {k: sum(n for _, n in x) for k, x in by_sequence.items()}


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(o.base, "LEAST_PARTS", 7)
    rng = random.Random(1)
    rows = [(i, sentence(rng, rng.randint(0, 300))) for i in range(60)] + [(70 + i, "the same words here") for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "long " * 30_000), (204, "x" * 4000), (None, "<|endoftext|> end"), (None, None)]
    df = odd_documents(spark, rows)
    got = o.curve_sequences(df, PATH, capacity=256).collect()
    sizes = whole(got)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(ids_of(t))
    assert sum(sizes.values()) == sum(len(x) for v in want.values() for x in v)
    assert sorted(sizes) == list(range(len(sizes))) and sum(n < 256 for n in sizes.values()) <= 8
    assert all(n & (n - 1) == 0 for n in sizes.values())
    pieces = {}
    for r in got:
        pieces.setdefault(r.id, []).append(r)
        assert len(r.ids) == 4 * r.length
    for i, v in want.items():
        if len(v) == 1:
            mine = sorted(pieces[i], key=lambda r: r.start)
            assert np.frombuffer(b"".join(r.ids for r in mine), "<u4").tolist() == v[0] and {r.doc_tokens for r in mine} == {len(v[0])}
            # consecutive pieces lie in consecutive sequences
            assert [r.sequence_id - mine[0].sequence_id for r in mine] == list(range(len(mine)))
    assert sorted(r.doc_tokens for r in pieces[None] if r.start == 0) == sorted(len(x) for x in want[None])


def test_equal_documents_lie_together_and_topics_apart(spark):
    rng = random.Random(5)
    topics = ["abcd", "ijkl", "qrst"]
    rows = [(i, sentence(rng, 60, topics[i % 3])) for i in range(150)] + [(1000 + i, "copy of one text " * 9) for i in range(30)]
    rng.shuffle(rows)
    got = o.curve_sequences(odd_documents(spark, rows), PATH, capacity=512).collect()
    order = [r.id for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    kind = [3 if i >= 1000 else i % 3 for i in order]
    copies = [k for k, x in enumerate(kind) if x == 3]
    assert copies[-1] - copies[0] == 29
    same = sum(a == b for a, b in zip(kind, kind[1:]))
    assert same > 0.8 * len(kind)  # a third by chance


def test_copies_fill_many_ranges(spark):
    df = spark.range(4000).select(F.col("id").alias("uid"), F.lit(3).cast("long").alias("n"), F.lit(0.5).alias("y0"), F.lit(0.5).alias("y1"))
    got = [r.at for r in o.along_curve(df, range_rows=50).collect()]
    assert sorted(got) == list(range(0, 12000, 3))


def test_empty_table(spark):
    assert o.curve_sequences(odd_documents(spark, [(1, "a")]).where(F.lit(False)), PATH).count() == 0


def test_query(spark):
    rows = o.op13_curve_packing(spark, SMALL).collect()
    sizes = whole(rows)
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sizes.values())
    own = Tokenizer.from_file(PATH)
    docs = {r.doc_id: own.encode(r.text or "", add_special_tokens=False).ids + [1] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs) and sum(sizes.values()) == sum(map(len, docs.values()))
    for r in rows:
        ids = np.array(docs[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert r.doc_tokens == len(docs[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids.tobytes())
