import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkgauge.llm import op9_packing as o

from .helpers import odd_documents, sentence

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"


def fewest(lengths, capacity):
    """Fewest bins by trying all placements."""
    best = [len(lengths)]
    lengths = sorted(lengths, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0] and i < len(lengths):
            return
        if i == len(lengths):
            best[0] = min(best[0], len(rooms))
            return
        for room in sorted(set(rooms)):
            if room >= lengths[i]:
                rest = list(rooms)
                rest.remove(room)
                go(i + 1, rest + [room - lengths[i]])
        go(i + 1, rooms + [capacity - lengths[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_bounds_hold_and_bins_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 12, 30])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
    where, offset, bins = o.best_fit(np.array(lengths), capacity)
    right = fewest(lengths, capacity)
    assert o.least_bins(np.array(lengths), capacity) <= right <= bins
    for b in range(bins):
        inside = sorted((offset[i], lengths[i]) for i in range(len(lengths)) if where[i] == b)
        assert [p for p, _ in inside] == list(np.cumsum([0] + [n for _, n in inside])[:-1]) and sum(n for _, n in inside) <= capacity


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert [a for a, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= capacity
    return len(by)


def test_packing_rounds(spark, monkeypatch):
    monkeypatch.setattr(o, "PART_PIECES", 400)
    rng = random.Random(3)
    lengths = [rng.choice([rng.randint(1, 100), 34, 51, 100]) for _ in range(1500)]
    df = spark.createDataFrame([(i % 500, n, "k") for i, n in enumerate(lengths)], "doc_id long, length int, offset string")
    rows = o.pack_pieces(df, capacity=100).collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    bins = check(rows, 100)
    assert bins <= o.least_bins(np.array(lengths), 100) * 1.01 + 2
    assert o.pack_pieces(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="a length is not"):
        o.pack_pieces(df.withColumn("length", F.lit(None).cast("int"))).collect()


def test_pieces_are_those_of_the_tokenizer(spark):
    rng = random.Random(5)
    rows = [(1, sentence(rng, 3000)), (2, None), (3, ""), (4, "<|endoftext|> x <|endoftext|>"), (4, "a"), (None, " \n\n  b\t"), (5, "é漢字 🙂'll 12345 ###  x" * 40), (6, "ab " * 2047)]
    rows += [(7, "x" * 20_000), (8, "\r\n" * 3000), (9, "a" + "́" * 50)]
    rows += [(10, "x <|endoftext|> y"), (11, "<|endoftext|>" * 2100), (12, "<|endoftext|")]
    own = Tokenizer.from_file(PATH)
    assert own.encode("x <|endoftext|> y", add_special_tokens=False).ids == [87, 220, 50256, 331]
    want = sorted([(i, own.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows], key=str)
    got = {}
    pieces = o.token_pieces(odd_documents(spark, rows).withColumn("nr", F.monotonically_increasing_id()), PATH).collect()
    texts, last = [], None
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length <= 2048
        if p.piece == 0:
            texts.append((p.id, []))
            last = None
        assert p.start == len(texts[-1][1]) and (last is None or p.length == 2048)
        texts[-1][1].extend(ids)
        last = p.length
    assert sorted(texts, key=str) == want
    del got


def test_both_libraries_give_the_same_ids(tmp_path):
    import json

    spec = json.load(open(PATH))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    other = tmp_path / "prefix.json"
    other.write_text(json.dumps(spec))
    assert o.encoder(str(other))("a b").tolist() == Tokenizer.from_file(str(other)).encode("a b").ids


def test_query(spark):
    rows = o.op9_best_fit_packing(spark, SMALL).collect()
    check(rows, 2048)
    own = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        ids = np.array(own.encode(docs[r.doc_id], add_special_tokens=False).ids + [0], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
