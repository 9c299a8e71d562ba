"""Substring dedup by hashing lines or paragraphs (operator 8).

A text is cut into units: lines (the default), paragraphs, or the sentences of
its lines, where a sentence of more than ``LONG_WORDS`` words is cut again
after words that a hash of the word picks.  A unit is normalised (A-Z
lower-cased, runs of spaces joined, marks at both ends dropped) and hashed to
128 bits.  Over the whole corpus the earliest occurrence of a digest, by
document id and then offset, stays; the others are removed, and reported with
their offsets in the original text.  Shorter units than ``MIN_WORDS`` words and
``MIN_CHARS`` code points stay: licence lines, headings and the like are no copies.

Units miss passages of short lines and passages inside a line.
``removed_passages`` finds every repeated run of ``PASSAGE`` words exactly,
wherever lines end: of all windows of that many words the earliest stays, the
words of the others are removed.  Words are runs of non-spaces, compared
without case and without marks at their ends.  Every window of ``PASSAGE`` words
names its least hash of ``GRAM`` words, about one word in 12; equal windows name
the same one.  A named place is one row: its hash, the hash of all words that
its windows can reach, and the characters from its first window to its last.
Places that agree in both hashes have the same windows, so all but the earliest lose
them as they stand; only the earliest place of each surrounding, where one named
hash has several, is taken apart into windows.  Named hashes that occur once are left out
before anything else is shuffled.  Sides of joins grow with the corpus, so
none is broadcast and the plan is the same at every size.  A hash that a third of
all documents hold is dealt over ``SALTS`` parts by document; aggregates note in a
bit mask which parts hold it, and the small side is repeated for those alone.
A window that overlaps its own first occurrence loses only the words beyond it.
``removed`` has the units and the passages, told apart by ``kind``; spans may overlap.

Defined results: null and empty texts have no units; a null id ranks after all
others and is reported as null, and ids are cast to long; repeated rows of one id:
their units have equal ranks and stay alike; an empty table gives an empty
result; other columns are left alone by ``remove_units``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballot.llm import words as W
from ballot.llm.graph import staged

#: A unit of fewer words and of fewer code points (for writing without spaces) stays.
MIN_WORDS = 20
MIN_CHARS = 160
LONG_WORDS = 30
#: Words of the shortest passage that is removed wherever it lies, and of the hashes that lead to it.
PASSAGE = 50
GRAM = 26
#: Parts of a frequent hash; their mask fills a long.
SALTS = 64
NO_ID = 2**63 - 1
_UNIT = {
    "line": re.compile(r"[^\n]+"),
    "paragraph": re.compile(r"(?:[^\n]+(?:\n(?!\s*\n))?)+"),
    "sentence": re.compile(r"[^\n.!?]+[.!?]*"),
}
_WORD = re.compile(r"[^ \t-\r]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_MARKS = " \t\n\x0b\x0c\r.,;:!?\"'()[]"
_MARK_BYTES = np.isin(np.arange(256), list(_MARKS.encode()))


def units(text: str, unit: str = "line", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of each unit that is long enough."""
    for m in _UNIT[unit].finditer(text):
        s, e = m.span()
        if e - s < min(2 * min_words - 1, min_chars):
            continue
        cuts = [(s, e)]
        if unit == "sentence" and e - s > 2 * LONG_WORDS:
            words = [w.span() for w in _WORD.finditer(text, s, e)]
            if len(words) > LONG_WORDS:
                ends = [b for a, b in words if zlib.crc32(text[a:b].translate(_LOWER).encode()) % 16 == 0]
                cuts = list(zip([s, *ends], [*ends, e]))
        for a, b in cuts:
            found = _WORD.findall(text[a:b])
            key = " ".join(found).translate(_LOWER).strip(_MARKS)
            if key and (len(found) >= min_words or len(key) >= min_chars):
                lead = len(text[a:b]) - len(text[a:b].lstrip(" \t\n\x0b\x0c\r"))
                yield a + lead, b, hashlib.md5(key.encode()).digest()


def removed_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each removed unit: doc_id, char_start, char_end, and the
    occurrence that stays: kept_doc_id, kept_start; text_hash tells apart the
    texts of one id."""

    def run(batches):
        for batch in batches:
            doc, whole, start, end, digest = [], [], [], [], []
            for d, t, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                for s, e, key in units(t.as_py() or "", unit, min_words, min_chars):
                    doc.append(NO_ID if d is None else d)
                    whole.append(h)
                    start.append(s)
                    end.append(e)
                    digest.append(key)
            k = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(doc, pa.int64()), pa.array(whole, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["k1", "k2", "doc", "h", "s", "e"])

    rows = docs.select(F.col(doc_id).cast("long"), text, F.xxhash64(text))
    found = staged(rows.mapInArrow(run, "k1 long, k2 long, doc long, h long, s long, e long"), "units")
    first = found.groupBy("k1", "k2").agg(F.min("doc").alias("own"), F.max("doc").alias("_last"), F.min("s").alias("_s"), F.max("s").alias("_e"))
    twice = staged(first.filter("own < _last or _s < _e").select("k1", "k2", "own"), "unit-keys")
    again = staged(found.join(twice.hint("merge"), ["k1", "k2"]), "unit-repeats")
    # where the earliest document holds the unit first
    kept = again.filter("doc = own").groupBy("k1", "k2").agg(F.min("s").alias("at"))
    out = again.join(kept, ["k1", "k2"]).filter("doc > own or s > at")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("doc").alias("doc_id"), F.col("s").alias("char_start"), F.col("e").alias("char_end"), real("own").alias("kept_doc_id"), F.col("at").alias("kept_start"), F.col("h").alias("text_hash"))


def _bare_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words: fingerprint without the marks at both ends, byte start and
    end, and number of the text; and the texts' bytes and offsets."""
    data, off = W.utf8(col)
    starts, ends, first = W.word_bounds(data, off)
    text = np.repeat(np.arange(len(col)), np.diff(first))
    plain = np.flatnonzero(~_MARK_BYTES[data])
    at = np.searchsorted(plain, starts)
    last = np.searchsorted(plain, ends) - 1
    some = last >= at  # words of marks alone stay as they are
    a, b = starts.copy(), ends.copy()
    a[some], b[some] = plain[at[some]], plain[last[some]] + 1
    return W.word_hashes(data, a, b), starts, ends, text, data, off


def _sliding(v: np.ndarray, n: int, least: np.ufunc) -> np.ndarray:
    """``least`` of each n neighbours (n <= len(v)), by doubling."""
    m, size = len(v) - n + 1, 1
    while size * 2 <= n:
        v = least(v[:-size], v[size:])
        size *= 2
    return least(v[:m], v[n - size : n - size + m])


def _whole(text: np.ndarray, passage: int) -> np.ndarray:
    """Whether the ``passage`` words from each place on are of one text."""
    return text[: len(text) - passage + 1] == text[passage - 1 :]


def _places(h: np.ndarray, text: np.ndarray, passage: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each gram that is the least of a whole window: its hash, the hash of
    all words that windows with it can reach, and the first and the last window that name it."""
    if len(h) < passage:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    g, n = W.windows(h, gram), passage - gram + 1
    least = np.where(_whole(text, passage), _sliding(g, n, np.minimum), np.uint64(0))
    edge = np.zeros(n - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), n, np.maximum) == g)
    around = at[:, None] + np.arange(1 - n, 1)
    names = (around >= 0) & (around < len(least))
    names &= least[np.clip(around, 0, len(least) - 1)] == g[at][:, None]
    lo, hi = at - (n - 1) + names.argmax(1), at - names[:, ::-1].argmax(1)
    # the grams at both ends of the reach and the one between cover it
    left = np.maximum(at - (n - 1), np.searchsorted(text, text[at]))
    right = np.minimum(at + (n - 1), np.searchsorted(text, text[at], side="right") - gram)
    ends = ((at - left) * passage + (right - at)).astype(np.uint64)
    return g[at], W.mix(g[left] + W.mix(g[right] + W.mix(ends))), lo, hi


def _first_of(row: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each entry the index of the entry with its row and key that has the least place."""
    o = np.lexsort((at, key, row))
    new = np.ones(len(o), bool)
    new[1:] = (key[o][1:] != key[o][:-1]) | (row[o][1:] != row[o][:-1])
    out = np.empty(len(o), np.int64)
    out[o] = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))]
    return out


class _Chars:
    """Code point offsets, within their texts, of the words of a batch."""

    def __init__(self, starts, ends, text, data, off):
        chars = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
        self.start, self.end = (chars[x] - chars[off[text]] for x in (starts, ends))


def _beyond(h: np.ndarray, text: np.ndarray, chars: _Chars, places: tuple[np.ndarray, ...], passage: int) -> np.ndarray:
    """Where the removal of each place begins: at its first window, but not
    before the end of the first occurrence of a window in the same text."""
    g, _, lo, hi = places
    start = chars.start[lo]
    row = text[lo]
    again = np.zeros(text[-1] + 1 if len(text) else 0, bool)
    again[row[_first_of(row, g, lo) != np.arange(len(g))]] = True
    words = np.flatnonzero(again[text])
    if not len(words):
        return start
    h, text = h[words], text[words]
    p = np.flatnonzero(_whole(text, passage))
    own = p[_first_of(text[p], W.windows(h, passage)[p], p)]
    begin = np.full(len(chars.start) + passage, np.iinfo(np.int64).max)
    begin[words[p]] = np.where(own < p, np.maximum(chars.start[words[p]], chars.end[words[own] + passage - 1]), chars.start[words[p]])
    those = np.flatnonzero(again[row])
    window = lo[those][:, None] + np.arange(passage)
    start[those] = np.where(window <= hi[those][:, None], begin[window], np.iinfo(np.int64).max).min(1)
    return start


def _salt(*names: str):
    return F.pmod(F.xxhash64(*names), F.lit(SALTS)).cast("int").alias("salt")


def _mask():
    """The parts that hold a key, as bits."""
    return F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask")


def _for_parts(df: DataFrame) -> DataFrame:
    """A row of ``df`` for each part in its mask."""
    parts = F.expr(f"explode(filter(sequence(0, {SALTS - 1}), i -> (shiftrightunsigned(mask, i) & 1L) = 1L))")
    return df.withColumn("salt", parts).drop("mask").hint("merge")


def removed_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """As ``removed_units``, a row for each removed stretch of repeated windows
    of ``passage`` words; the occurrence that stays is its first window's.
    ``gram`` is at least half of ``passage``."""
    if not passage / 2 <= gram <= passage:
        raise ValueError("gram must lie between half of passage and passage")

    def name(batches):
        for batch in batches:
            col, part = batch.column(0), batch.column(1).to_numpy()
            for a, b in W.slices(len(col), W.utf8(col)[1]):
                h, _, _, t, _, _ = _bare_words(col.slice(a, b - a))
                g, _, lo, _ = _places(h, t, passage, gram)
                g, which, n = np.unique(g, return_inverse=True, return_counts=True)
                mask = np.zeros(len(g), np.int64)
                np.bitwise_or.at(mask, which, np.int64(1) << part[a + t[lo]].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n), pa.array(mask)], names=["g", "n", "mask"])

    def place(batches):
        for batch in batches:
            ids, whole, col = batch.column(0), batch.column(1), batch.column(2)
            for a, b in W.slices(len(col), W.utf8(col)[1]):
                h, starts, ends, t, data, off = _bare_words(col.slice(a, b - a))
                g, c, lo, hi = _places(h, t, passage, gram)
                chars = _Chars(starts, ends, t, data, off)
                row = t[lo]
                ints = (lo - np.searchsorted(t, row), hi - lo + 1, chars.start[lo], _beyond(h, t, chars, (g, c, lo, hi), passage), chars.end[hi + passage - 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), ids.take(pa.array(row + a)), whole.take(pa.array(row + a)), *(pa.array(x.astype(np.int32)) for x in ints)],
                    names=["g", "c", "doc", "h", "at", "n", "s", "f", "e"],
                )

    def window(batches):
        for batch in batches:
            ids, whole, col, lists = batch.column(0), batch.column(1), batch.column(2), batch.column(3)
            for a, b in W.slices(len(col), W.utf8(col)[1]):
                h, starts, ends, t, data, off = _bare_words(col.slice(a, b - a))
                mine = lists.slice(a, b - a)
                flat = mine.flatten()
                at, n, g, c = (np.asarray(flat.field(i)) for i in range(4))
                first = np.searchsorted(t, np.arange(b - a))
                begin = np.repeat(first, mine.value_lengths().to_numpy()) + at
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                p = np.repeat(begin, n) + step
                row, k = t[p], W.windows(h, passage)[p]
                chars = _Chars(starts, ends, t, data, off)
                own = p[_first_of(row, k, p)]
                s, e = chars.start[p], chars.end[p + passage - 1]
                f = np.where(own < p, np.maximum(s, chars.end[own + passage - 1]), s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k.view(np.int64)), ids.take(pa.array(row + a)), whole.take(pa.array(row + a)), *(pa.array(x.astype(np.int32)) for x in (p - first[row], s, f, e)), pa.array(np.repeat(g, n)), pa.array(np.repeat(c, n)), pa.array(step == 0)],
                    names=["k", "doc", "h", "at", "s", "f", "e", "g", "c", "top"],
                )

    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("h"), F.col(text).alias("t")).filter("t is not null")
    counted = rows.select("t", _salt("doc", "h")).mapInArrow(name, "g long, n long, mask long").groupBy("g").agg(F.sum("n").alias("n"), F.bit_or("mask").alias("mask"))
    common = staged(counted.filter("n > 1").select("g", "mask"), "gram-keys")
    places = rows.mapInArrow(place, "g long, c long, doc long, h long, at int, n int, s int, f int, e int").withColumn("salt", _salt("doc", "h"))
    hits = staged(places.join(_for_parts(common), ["g", "salt"]), "gram-places")
    # the earliest place of each surrounding, and whether there are later ones
    classes = hits.groupBy("g", "c").agg(F.min(F.struct("doc", "at", "s", "h", "n")).alias("own"), F.max(F.struct("doc", "at")).alias("last"), _mask())
    classes = staged(classes.select("g", "c", "own", "mask", F.expr("own.doc < last.doc or own.at < last.at").alias("later")), "gram-classes")
    each = classes.select("g", "c", "own", _salt("c"))
    several = _for_parts(each.groupBy("g").agg(F.count("*").alias("n"), _mask()).filter("n > 1").select("g", "mask"))
    apart = each.join(several, ["g", "salt"]).groupBy("own.doc", "own.h").agg(F.collect_list(F.struct("own.at", "own.n", "g", "c")).alias("places"))
    near = rows.join(apart.hint("merge"), ["doc", "h"]).select("doc", "h", "t", "places")
    windows = near.mapInArrow(window, "k long, doc long, h long, at int, s int, f int, e int, g long, c long, top boolean")
    windows = staged(windows, "windows").withColumn("salt", _salt("doc", "h"))
    first = windows.groupBy("k").agg(F.min(F.struct("doc", "at", "s")).alias("own"), F.max(F.struct("doc", "at")).alias("last"), _mask())
    first = first.filter("own.doc < last.doc or own.at < last.at").select("k", F.col("own.doc").alias("own"), F.col("own.at").alias("own_at"), F.col("own.s").alias("kept"), "mask")
    twice = _for_parts(staged(first, "window-keys"))
    again = staged(windows.join(twice, ["k", "salt"]).filter("doc > own or (doc = own and at > own_at)").drop("k", "salt", "at", "s", "own_at"), "window-repeats")
    # where the first window of a surrounding is kept
    top = again.filter("top").groupBy("g", "c").agg(F.min(F.struct("own", "kept")).alias("kept"))
    kept = classes.filter("later").join(top.hint("merge"), ["g", "c"], "left")
    kept = kept.select("g", "c", "own", "mask", F.coalesce("kept.own", "own.doc").alias("kept_doc"), F.coalesce("kept.kept", "own.s").alias("kept"))
    later = hits.join(_for_parts(kept), ["g", "c", "salt"]).filter("doc > own.doc or (doc = own.doc and at > own.at)")
    spans = later.select("doc", "h", "f", "e", F.col("kept_doc").alias("own"), "kept").unionByName(again.select("doc", "h", "f", "e", "own", "kept")).distinct()
    # the spans of one text, in order: stretches that overlap are one row
    order = Window.partitionBy("doc", "h").orderBy("f", "e", "own", "kept")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.coalesce(F.col("f") > before, F.lit(True)).cast("int"))
    stretch = marked.withColumn("_n", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = stretch.groupBy("doc", "h", "_n").agg(F.max("e").alias("e"), F.min(F.struct("f", "e", "own", "kept")).alias("k"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = out.select("doc", "h", "e", "k.f", "k.own", "k.kept")
    return out.select(real("doc").alias("doc_id"), F.col("f").cast("long").alias("char_start"), F.col("e").cast("long").alias("char_end"), real("own").alias("kept_doc_id"), F.col("kept").cast("long").alias("kept_start"), F.col("h").alias("text_hash"))


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The removed units and the removed passages."""
    lines = removed_units(docs, doc_id, text).withColumn("kind", F.lit("line"))
    return lines.unionByName(removed_passages(docs, doc_id, text).withColumn("kind", F.lit("passage")))


def remove_units(docs: DataFrame, removed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed spans cut out of their texts."""
    spans = removed.groupBy(F.col("doc_id").alias("_doc"), "text_hash").agg(F.sort_array(F.collect_set(F.struct("char_start", "char_end"))).alias("_spans"))
    names = docs.columns
    at = names.index(text)

    def run(batches):
        for batch in batches:
            out = []
            for t, cut in zip(batch.column(at), batch.column(len(names))):
                t, cut, last, kept = t.as_py(), cut.as_py(), 0, []
                for x in cut or []:
                    kept.append(t[last : max(last, x["char_start"])])
                    last = max(last, x["char_end"])
                out.append(t if not cut else "".join([*kept, t[last:]]))
            columns = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    both = docs.alias("d").join(spans.alias("x"), F.col(f"d.{doc_id}").eqNullSafe(F.col("x._doc")) & (F.xxhash64(F.col(f"d.{text}")) == F.col("x.text_hash")), "left")
    return both.select("d.*", F.col("x._spans").alias("_spans_of_units")).mapInArrow(run, docs.schema)
