"""Words of many texts as arrays: offsets, 64-bit hashes, rolling window hashes.

All functions work on one Arrow column inside a task.  A word is a run of bytes
other than space and U+0009 to U+000D of the UTF-8 text, unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes whose prefix sums are held at once.
BLOCK = 1 << 18
#: Text of an Arrow batch worked on at once.
SLICE_BYTES = 4_000_000

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all others."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
#: Base of the polynomial over the bytes of a word, and its inverse modulo 2**64.
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 2**64)
#: Base of the polynomial over the words of a window.
STEP = 0x2545F4914F6CDD1D
_POWERS: list[np.ndarray] = [np.empty(0, U), np.empty(0, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(n, base, dtype=U)
            p[:1] = 1
            _POWERS[k] = np.cumprod(p, dtype=U)
    return _POWERS[0], _POWERS[1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column back to back, and where each text starts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``most`` bytes of text each; no text is cut."""
    _, offsets = text_bytes(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """``start`` and ``end`` byte, ``doc`` (row) and ``hash`` of every word of a text column."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = data, offsets = text_bytes(texts)
        self.docs = len(offsets) - 1
        space = SPACE[data]
        first, last = ~space, ~space
        if len(data):
            first[1:] &= space[:-1]
            last[:-1] &= space[1:]
            full = np.flatnonzero(np.diff(offsets))
            begin, stop = offsets[full], offsets[full + 1] - 1
            first[begin], last[stop] = ~space[begin], ~space[stop]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.counts = np.bincount(self.doc, minlength=self.docs)
        self.begin = np.concatenate([[0], np.cumsum(self.counts)])

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            out = np.empty(len(self.start), dtype=U)
            at = 0
            while at < len(out):
                to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + BLOCK, "right")))
                low, high = self.start[at], self.end[to - 1]
                up, down = powers(int(high - low))
                sums = np.zeros(high - low + 1, dtype=U)
                np.cumsum(BYTE[self.data[low:high]] * up[: high - low], dtype=U, out=sums[1:])
                s, e = self.start[at:to] - low, self.end[at:to] - low
                out[at:to] = (sums[e] - sums[s]) * down[s]
                at = to
            self._hash = mix(out)
        return self._hash

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``n`` words from each word on, and whether they are of one text."""
        if len(self) < n:
            return np.empty(0, U), np.empty(0, bool)
        return mix(rolling(self.hash, n)), self.doc[: len(self) - n + 1] == self.doc[n - 1 :]


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Polynomial of ``n`` consecutive values from each place on, put together from doubled lengths."""
    out, have, power, size = None, 0, values, 1
    rest = n
    while rest:
        if rest & 1:
            if out is None:
                out, have = power, size
            else:
                m = min(len(out), len(power) - have)
                out = out[:m] * U(pow(STEP, size, 2**64)) + power[have : have + m]
                have += size
        rest >>= 1
        if rest:
            power = power[: len(power) - size] * U(pow(STEP, size, 2**64)) + power[size:]
            size *= 2
    return out[: len(values) - n + 1]


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :width] = raw
    return out.view("<u8").reshape(-1).astype(U)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window of ``width`` from one of the starts."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, np.minimum(starts + width, n), 1)
    return np.cumsum(edge[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
