"""Vectorised text kernels over Arrow string columns: word spans, word hashes, rolling k-gram hashes.

A kernel works on slices of about SLICE_BYTES of text, so a worker's memory
depends on the slice and on the longest single text, not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

#: Separators of plain words: space and the characters from tab to carriage return.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of word characters that are ASCII letters, ASCII digits or beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes that begin a code point.
LEADS = (np.arange(256) & 0xC0) != 0x80

U = np.uint64


def _splitmix(n: int, seed: int) -> np.ndarray:
    z = (np.arange(1, n + 1, dtype=np.uint64) + U(seed)) * U(0x9E3779B97F4A7C15)
    return mix(z)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_BYTE = _splitmix(256, 11) | U(1)
_BASE = U(0xD1342543DE82EF95)
_BACK = U(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        m = max(n, SLICE_BYTES + 4096)
        for k, base in enumerate((_BASE, _BACK)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of parts of a string column; null counts as empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def spans(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of table's bytes, which never cross a text's end, and each text's bounds in them."""
    w = table[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    s = offs[:-1][offs[:-1] < len(data)]
    first[s] = w[s]
    e = offs[1:][offs[1:] > 0] - 1
    last[e] = w[e]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which any span's hash follows."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes; equal bytes have equal hashes wherever they stand."""
    h = (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) << U(48)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_sums(data), starts, ends)


_STEP = U(0x9FB21C651E98DF25)


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive values; out[i] covers h[i : i + k]."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _STEP + h[j : j + n]
    return mix(out + U(k))


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each element the text that it belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes at which k elements of one text begin, and that text."""
    total = int(bounds[-1])
    doc = owners(bounds)
    if total < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: total - k + 1] == doc[k - 1 :])
    return at, doc[at]
