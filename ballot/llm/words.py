"""Words and word shingles of whole Arrow string batches, vectorised.

A word is a maximal run of bytes other than ``[\\x20\\x09-\\x0D]``; A-Z count
as a-z.  Each word becomes a 64-bit fingerprint (random table entry of every
byte times a power of its place, then mixed), so later steps compare integers.  Two
different words share a fingerprint with a chance of about 2**-64.
Null texts have no words.  Work arrays stay small for long texts: only byte
masks cover a whole text, the 8-byte arrays cover ``_SPAN`` bytes at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPAN = 1 << 17  # bytes hashed at once
_POWER = np.cumprod(np.full(_SPAN, _BASE, np.uint64))
_UNPOWER = np.cumprod(np.full(_SPAN, pow(_BASE, -1, 2**64), np.uint64))
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Separators of ``alnum`` words: every ASCII byte that is no letter or digit.
_NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_CHUNK = 8192
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection whose output bits all depend on x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _K2
    x ^= x >> np.uint64(27)
    x *= _K3
    x ^= x >> np.uint64(31)
    return x


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and the offset at which each text begins (n + 1)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_bounds(data: np.ndarray, off: np.ndarray, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the number of the first word of each text (n + 1)."""
    inside = ~(_NOT_ALNUM if alnum else _SPACES)[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[off] = True
    edge = inside.copy()
    edge[1:] &= ~inside[:-1] | first[1:-1]
    starts = np.flatnonzero(edge)
    edge = inside
    edge[:-1] &= ~inside[1:] | first[1:-1]
    ends = np.flatnonzero(edge) + 1
    return starts, ends, np.searchsorted(starts, off)


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _POWER[: len(values)], out=out[1:])
    return out


def _long_word(values: np.ndarray) -> np.uint64:
    total = 0
    for lo in range(0, len(values), _SPAN):
        total += int(_sums(values[lo : lo + _SPAN])[-1]) * pow(_BASE, lo, 2**64)
    return np.uint64(total * pow(_BASE, -1, 2**64) % 2**64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, alnum: bool = False) -> np.ndarray:
    """Per word the sum of its bytes' table entries times powers of an odd
    base, from prefix sums over all bytes of a chunk of words (modulo 2**64)."""
    table = np.where(_NOT_ALNUM if alnum else _SPACES, np.uint64(0), _BYTE[_LOWER])
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = min(a + _CHUNK, len(starts), int(np.searchsorted(ends, starts[a] + _SPAN, side="right")))
        if b <= a:
            out[a] = _long_word(table.take(data[starts[a] : ends[a]]))
            a += 1
            continue
        lo = starts[a]
        sums = _sums(table.take(data[lo : ends[b - 1]]))
        out[a:b] = (sums[ends[a:b] - lo] - sums[starts[a:b] - lo]) * _UNPOWER[starts[a:b] - lo]
        a = b
    return mix(out + (ends - starts).astype(np.uint64) * _K1)


def words_of(col: pa.Array, alnum: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of a column, and where each text's words begin."""
    data, off = utf8(col)
    starts, ends, first = word_bounds(data, off, alnum)
    return word_hashes(data, starts, ends, alnum), first


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the n-word windows that begin at each of len(h) - n + 1 places."""
    m = len(h) - n + 1
    acc = np.full(max(m, 0), n, np.uint64)
    for j in range(n if m > 0 else 0):
        acc = acc * _K1 + h[j : j + m]
        acc ^= acc >> np.uint64(29)
    return mix(acc)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of one text's n-word shingles, in order; a text with fewer
    words is one shingle as a whole, and a text without words has none."""
    return windows(h, min(n, len(h))) if len(h) else h


def slices(rows: int, off: np.ndarray, most: int = 4 << 20):
    """Consecutive row ranges of a batch of about ``most`` bytes each (one row at least)."""
    a = 0
    while a < rows:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield a, min(b, rows)
        a = min(b, rows)
