"""Benchmark decontamination (operator 1): SimHash windows of the items' sizes.

Words are runs of letters and digits (A-Z count as a-z, any non-ASCII byte as
a letter), so case and punctuation do not hide a leak.  For an item of L words
every window of L words of a document is a possible copy:

1. A window that shares no five-word shingle with any item has similarity 0
   with all of them; places that share one are found first, and only windows
   over such a place go on.
2. Each such window gets a 64-bit SimHash of its words.  An index holds every
   item's SimHash in four 16-bit blocks, each block under every value within
   Hamming distance ``RADIUS // 4`` of it.  If two fingerprints differ in at
   most ``RADIUS`` bits, one block differs in at most a quarter of that, so
   looking up the four blocks finds every item within the radius.
3. Candidates are verified exactly: the weighted Jaccard similarity of the two
   multisets of five-word shingles, where a shingle weighs as many as it has
   distinct words.  Pairs of ``threshold`` or more are leaks.

Documents are only mapped, never shuffled.  The benchmark is a stated query
set: it is read in blocks of at most ``BLOCK_ITEMS`` items, one index each, so
what a task holds does not grow with it.

Defined results: null or empty texts hold and match nothing; an item of fewer
than five words is one shingle and matches only windows equal to it; repeated
documents are reported each; of an item's windows in a document the most
similar, then the first, is reported; an empty benchmark or table gives no
leaks.  Columns other than the named ones are left alone.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ballot.llm import words as W

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 15
BLOCK_ITEMS = 1000
_BLOCKS, _BITS = 4, 16
_FILTER_BITS = 22


def simhash(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from rows of 64 signed bit sums."""
    return np.packbits(sums > 0, axis=-1).view(np.uint64).reshape(sums.shape[:-1])


def bit_signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each word fingerprint."""
    return np.unpackbits(W.mix(h).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def shingle_counts(h: np.ndarray) -> dict[int, tuple[int, int]]:
    """Shingle fingerprint -> (occurrences, weight)."""
    k = min(SHINGLE, len(h))
    g = W.windows(h, k).tolist()
    n, words = Counter(g), h.tolist()
    return {x: (n[x], len(set(words[i : i + k]))) for i, x in enumerate(g)}


def similarity(a: dict, b: dict) -> float:
    both = sum(min(n, b[x][0]) * w for x, (n, w) in a.items() if x in b)
    return both / (sum(n * w for n, w in a.values()) + sum(n * w for n, w in b.values()) - both)


class Index:
    """One block of items, ready for lookups."""

    def __init__(self, items: list[tuple[object, str]]):
        h, first = W.words_of(pa.array([t for _, t in items], pa.string()), alnum=True)
        self.items = [(i, h[a:b]) for (i, _), a, b in zip(items, first, first[1:]) if b > a]
        self.size = np.array([len(x) for _, x in self.items])
        self.counts = [shingle_counts(x) for _, x in self.items]
        self.prints = simhash(np.array([bit_signs(x).sum(0) for _, x in self.items]).reshape(-1, 64))
        by_k: dict[int, set[int]] = defaultdict(set)
        for x, c in zip(self.size, self.counts):
            by_k[min(SHINGLE, int(x))].update(c)
        self.known, self.maybe = {}, {}
        for k, found in by_k.items():
            self.known[k] = np.array(sorted(found), np.uint64)
            self.maybe[k] = np.zeros(1 << _FILTER_BITS, bool)
            self.maybe[k][self.known[k] >> np.uint64(64 - _FILTER_BITS)] = True
        near = [sum(1 << b for b in bits) for r in range(RADIUS // _BLOCKS + 1) for bits in combinations(range(_BITS), r)]
        blocks = self.prints.view(np.uint16).reshape(-1, _BLOCKS)
        self.table = []
        for j in range(_BLOCKS):
            values = (blocks[:, j, None] ^ np.array(near, np.uint16)).ravel()
            owner = np.repeat(np.arange(len(blocks), dtype=np.int32), len(near))
            order = np.argsort(values, kind="stable")
            self.table.append((np.searchsorted(values[order], np.arange((1 << _BITS) + 1)), owner[order]))

    def anchors(self, h: np.ndarray, k: int) -> np.ndarray:
        g = W.windows(h, k)
        at = np.flatnonzero(self.maybe[k].take(g >> np.uint64(64 - _FILTER_BITS)))
        i = np.searchsorted(self.known[k], g[at])
        i[i == len(self.known[k])] = 0
        return at[self.known[k][i] == g[at]]

    def candidates(self, prints: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
        """(window, item) whose fingerprints differ in at most RADIUS bits."""
        blocks = prints.view(np.uint16).reshape(-1, _BLOCKS)
        found = set()
        for j, (begin, owner) in enumerate(self.table):
            lo, n = begin[blocks[:, j]], np.diff(begin)[blocks[:, j]]
            window = np.repeat(np.arange(len(prints)), n)
            item = owner[np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
            ok = self.size[item] == size
            window, item = window[ok], item[ok]
            ok = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
            found.update(zip(window[ok].tolist(), item[ok].tolist()))
        return iter(sorted(found))

    def leaks(self, h: np.ndarray, anchors: dict[int, np.ndarray], threshold: float) -> dict[int, tuple[float, int]]:
        """Item number -> (similarity, first word) of its best window in a text."""
        best: dict[int, tuple[float, int]] = {}
        for size in np.unique(self.size).tolist():
            k = min(SHINGLE, size)
            at = anchors.get(k)
            if at is None or not len(at) or len(h) < size:
                continue
            # windows that hold an anchored shingle
            cover = np.zeros(len(h) + 2, np.int32)
            np.add.at(cover, np.maximum(at - (size - k), 0), 1)
            np.add.at(cover, at + 1, -1)
            starts = np.flatnonzero(np.cumsum(cover)[: len(h) - size + 1] > 0)
            for a in range(0, len(starts), 4096):  # bounded work arrays for long texts
                s = starts[a : a + 4096]
                lo = s[0]
                # runs of starts that are far apart are summed apart
                for run in np.split(s, np.flatnonzero(np.diff(s) > 4 * size + 64) + 1):
                    lo = run[0]
                    sums = np.zeros((run[-1] + size - lo + 1, 64), np.int32)
                    np.cumsum(bit_signs(h[lo : run[-1] + size]), axis=0, out=sums[1:])
                    prints = simhash(sums[run - lo + size] - sums[run - lo])
                    for w, i in self.candidates(prints, size):
                        start = int(run[w])
                        sim = similarity(self.counts[i], shingle_counts(h[start : start + size]))
                        if sim >= threshold and (i not in best or (-sim, start) < (-best[i][0], best[i][1])):
                            best[i] = (sim, start)
        return best

    def scan(self, texts: pa.Array, threshold: float) -> Iterator[tuple[int, object, float, int, int]]:
        """(row, item, similarity, start, end in code points) of every leak of a batch."""
        data, off = W.utf8(texts)
        for a, b in W.slices(len(texts), off, 1 << 20):
            part, begin = data[off[a] : off[b]], off[a : b + 1] - off[a]
            starts, ends, first = W.word_bounds(part, begin, alnum=True)
            h = W.word_hashes(part, starts, ends, alnum=True)
            hits = {k: self.anchors(h, k) for k in self.known}
            rows = np.unique(np.concatenate([np.searchsorted(first, x, side="right") - 1 for x in hits.values()] or [np.zeros(0, np.int64)]))
            for r in rows.tolist():
                lo, hi = int(first[r]), int(first[r + 1])
                own = {k: x[(x >= lo) & (x + k <= hi)] - lo for k, x in hits.items()}
                found: dict[object, tuple] = {}
                for i, (sim, start) in self.leaks(h[lo:hi], own, threshold).items():
                    chars = np.cumsum((part[begin[r] : begin[r + 1]] & 0xC0) != 0x80)
                    s, e = starts[lo + start] - begin[r], ends[lo + start + int(self.size[i]) - 1] - begin[r]
                    row = (-sim, int(chars[s]) - 1, int(chars[e - 1]))
                    found[self.items[i][0]] = min(row, found.get(self.items[i][0], row))
                for item, (sim, s, e) in sorted(found.items(), key=lambda x: x[1]):
                    yield a + r, item, -sim, s, e


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[Index]:
    held: list = []
    for row in benchmark.select(item, text).toLocalIterator():
        if row[1]:
            held.append((row[0], row[1]))
        if len(held) == BLOCK_ITEMS:
            yield Index(held)
            held = []
    if held:
        yield Index(held)


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and item that it holds: (doc id, item id,
    similarity, char_start, char_end)."""
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField(item_id, benchmark.schema[item_id].dataType), T.StructField("similarity", T.DoubleType()), T.StructField("char_start", T.LongType()), T.StructField("char_end", T.LongType())])
    spark = docs.sparkSession
    out = spark.createDataFrame([], schema)
    for index in _blocks(benchmark, item_id, item_text):

        def run(batches, index=index):
            for batch in batches:
                found = list(index.scan(batch.column(1), threshold))
                if found:
                    row, item, sim, s, e = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item), pa.array(sim, pa.float64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=schema.names)

        out = out.unionByName(docs.select(doc_id, text).mapInArrow(run, schema))
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item, all columns kept."""
    at = docs.columns.index(text)
    for index in _blocks(benchmark, item_id, item_text):

        def run(batches, index=index):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in index.scan(batch.column(at), threshold)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
