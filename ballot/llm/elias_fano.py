"""Elias-Fano sequences and a two-level n-gram trie over them, in NumPy.

A sequence of n ascending integers below u keeps the low bits of each as whole
bytes and the high bits as a unary bit string, about 2 + log2(u / n) bits (up
to a byte's rounding) per integer.  Everything lives in one ``bytes`` object
that is looked at in place, so a level can be a Parquet or Arrow buffer, or a
memory-mapped file.
"""

from __future__ import annotations

import numpy as np

_HEAD = 3  # n, bytes of low bits, number of high buckets


def encode(values: np.ndarray) -> bytes:
    """Bytes of an ascending uint64 sequence (equal neighbours allowed)."""
    n = len(values)
    top = int(values[-1]) if n else 0
    k = 0
    while k < 7 and top >> (8 * k) > 4 * n + 64:
        k += 1
    buckets = (top >> (8 * k)) + 1
    bits = np.zeros(n + buckets, bool)
    bits[(values >> np.uint64(8 * k)).astype(np.int64) + np.arange(n)] = True
    low = np.ascontiguousarray(values).astype("<u8").view(np.uint8).reshape(n, 8)[:, :k]
    return np.array([n, k, buckets], "<i8").tobytes() + low.tobytes() + np.packbits(bits).tobytes()


class Sequence:
    """A view of encoded bytes; only the buckets' beginnings are unpacked."""

    def __init__(self, raw: bytes | memoryview):
        self.n, self.k, buckets = np.frombuffer(raw, "<i8", _HEAD).tolist()
        self.low = np.frombuffer(raw, np.uint8, self.n * self.k, 8 * _HEAD).reshape(self.n, self.k)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, -1, 8 * _HEAD + self.n * self.k), count=self.n + buckets)
        gaps = np.flatnonzero(bits == 0)
        # elements before the end of each bucket
        self.begin = np.append(0, gaps - np.arange(buckets)).astype(np.int32 if self.n < 2**31 else np.int64)

    def low_of(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for b in range(self.k):
            out |= self.low[i, b].astype(np.uint64) << np.uint64(8 * b)
        return out

    def values(self) -> np.ndarray:
        high = np.repeat(np.arange(len(self.begin) - 1, dtype=np.uint64), np.diff(self.begin))
        return high << np.uint64(8 * self.k) | self.low_of(np.arange(self.n))

    def successor(self, q: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the place of the first element that is not smaller,
        searched inside its bucket (and inside [first, last) where given), and
        whether that element equals the query."""
        shift = np.uint64(8 * self.k)
        j = q >> shift
        inside = j < len(self.begin) - 1
        j = np.where(inside, j, 0).astype(np.int64)
        lo, end = self.begin[j].astype(np.int64), self.begin[j + 1].astype(np.int64)
        if first is not None:
            lo, end = np.maximum(lo, first), np.minimum(end, last)
        want = q & ((np.uint64(1) << shift) - np.uint64(1))
        hi = np.maximum(end, lo)
        at = np.flatnonzero(lo < hi)
        while len(at):
            mid = (lo[at] + hi[at]) >> 1
            less = self.low_of(mid) < want[at]
            lo[at] = np.where(less, mid + 1, lo[at])
            hi[at] = np.where(less, hi[at], mid)
            at = at[lo[at] < hi[at]]
        found = inside & (lo < end)
        found[found] = self.low_of(lo[found]) == want[found]
        return lo, found


class Trie:
    """Contexts, pointers to their successors, and a code per successor.

    Successors are stored relative to their context: context number * 2**32 +
    word, which makes the level ascend; a lookup searches only between the
    context's two pointers.
    """

    def __init__(self, contexts: bytes, pointers: bytes, successors: bytes, codes: bytes):
        self.contexts, self.successors = Sequence(contexts), Sequence(successors)
        self.pointers = Sequence(pointers).values().astype(np.int64)
        self.codes = np.frombuffer(codes, np.uint8)

    @staticmethod
    def build(keys: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
        """Levels from ascending distinct keys (context << 32 | word)."""
        context = keys >> np.uint64(32)
        new = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
        number = np.repeat(np.arange(len(new), dtype=np.uint64), np.diff(np.append(new, len(keys))))
        pointers = np.append(new, len(keys)).astype(np.uint64)
        return encode(context[new]), encode(pointers), encode(number << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)), codes.astype(np.uint8).tobytes()

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The codes of keys, 0 where the trie lacks them."""
        out = np.zeros(len(keys), np.uint8)
        c, known = self.contexts.successor(keys >> np.uint64(32))
        c, at = c[known], np.flatnonzero(known)
        q = c.astype(np.uint64) << np.uint64(32) | keys[at] & np.uint64(0xFFFFFFFF)
        i, found = self.successors.successor(q, self.pointers[c], self.pointers[c + 1])
        out[at[found]] = self.codes[i[found]]
        return out
