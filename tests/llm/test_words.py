import random

import numpy as np
import pyarrow as pa

from inkgauge.llm import words as w

from .helpers import words

TEXTS = ["a b  c\n", None, "", " \t\n", "a b c d é  a b\x0b\x0cz", "x" * 300_000, " a", "\x1c\x85 b c", "漢字 テスト"]


def test_words_are_those_of_the_pattern():
    got = w.Words(pa.array(TEXTS))
    data = got.data.tobytes()
    assert [data[a:b].decode() for a, b in zip(got.start, got.end)] == [x for t in TEXTS for x in words(t)]
    assert got.counts.tolist() == [len(words(t)) for t in TEXTS]


def test_equal_words_and_windows_have_equal_hashes():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    got = w.Words(pa.array(texts))
    flat = [(d, x) for d, t in enumerate(texts) for x in words(t)]
    for n in (1, 2, 3, 5, 25):
        hashes, same = got.windows(n)
        seen, back = {}, {}
        for i in range(len(hashes)):
            whole = len({d for d, _ in flat[i : i + n]}) == 1
            assert whole == bool(same[i])
            if whole:
                key = tuple(x for _, x in flat[i : i + n])
                assert seen.setdefault(key, hashes[i]) == hashes[i]
                assert back.setdefault(int(hashes[i]), key) == key


def test_words_longer_than_a_block_and_slices():
    long = "y" * (3 * w.BLOCK)
    a, b = w.Words(pa.array([long + " z", "q"])), w.Words(pa.array(["q " + long, "z"]))
    assert a.hash[0] == b.hash[1] and a.hash[1] == b.hash[2] and a.hash[2] == b.hash[0]
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", None, "b" * 50, "", "c"])], names=["t"])
    assert [p.num_rows for p in w.slices(batch, "t", 10)] == [2, 1, 2]


def test_packing_of_numbers():
    x = np.array([0, 1, 2**40 - 1, 12345678901], dtype=np.uint64)
    assert w.unpack(w.pack(x, 5), 5).tolist() == x.tolist()
    assert w.covered(np.array([0, 3]), 2, 5).tolist() == [True, True, False, True, True]
