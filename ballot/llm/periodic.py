"""Periodic run detection by Baier grouping (operator 12).

A run is a stretch of words with smallest period q, at least ``max(least, 2 q)``
words long, that no neighbouring word extends with the same period.

The first phase of Baier's suffix sorter groups suffixes from the greatest
group down.  When a group is final, every member's nearest earlier suffix of a
lower group takes the group's context behind its own, once for each member that
it precedes, and moves into a new group right above its old one.  The contexts
that remain are the longest Lyndon words at each place: the Lyndon array comes
directly, without the second phase.  It is made under the order of the words
and under the reverse order.  Every run holds a Lyndon root of its period under
one of the two, so extending each root by its longest common extensions to the
right and left gives all runs; roots within an extension already known for their
period belong to it.

Before that a text loses the words that no run can hold: in a run of 12 words
or more every word lies in a window of six words that the text holds twice, so
only stretches covered by such windows are grouped.  That drops no run.

The runs are found per text, in Arrow batches on the executors; no shuffle.
Work per text is linear for the grouping, and memory is a few numbers a word.

Defined results: a null or empty text has no words and no runs, and collapses to
the empty string; a null id is kept as null; repeated rows are judged each; an
empty table gives an empty result; other columns are not read.  Words are
compared byte for byte, whatever their case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballot.llm import words as W

#: Words of the shortest run.
LEAST = 12
RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])


def lyndon_lengths(s: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place of ``s``."""
    n = len(s)
    members: list[list[int]] = []
    of = [0] * n
    for letter, i in sorted(zip(s, range(n))):
        if not members or s[members[-1][0]] != letter:
            members.append([])
        members[-1].append(i)
        of[i] = len(members) - 1
    length, size = [1] * len(members), [len(m) for m in members]
    lower, upper = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    # the places whose group is not final yet, linked; place n is the end of the list
    left, right = list(range(-1, n)), list(range(1, n + 1))
    right.append(n)
    now = len(members) - 1
    while now >= 0:
        if size[now]:
            moved: list[list[int]] = []  # place before, members that it precedes
            for i in members[now]:
                if of[i] != now:
                    continue
                before, after = left[i], right[i]
                left[after] = before
                if before < 0:
                    continue
                right[before] = after
                if moved and moved[-1][0] == before:
                    moved[-1][1] += 1
                else:
                    moved.append([before, 1])
            if len(moved) == 1 and size[of[moved[0][0]]] == 1:
                length[of[moved[0][0]]] += moved[0][1] * length[now]
            else:
                parts: dict[tuple[int, int], list[int]] = {}
                for j, k in moved:
                    parts.setdefault((of[j], k), []).append(j)
                # of the same group, more copies rank higher: the fewest go in last, right above it
                for (old, k), js in sorted(parts.items(), key=lambda x: -x[0][1]):
                    if len(js) == size[old]:
                        length[old] += k * length[now]
                        continue
                    new = len(members)
                    members.append(js)
                    length.append(length[old] + k * length[now])
                    size.append(len(js))
                    size[old] -= len(js)
                    for j in js:
                        of[j] = new
                    above = upper[old]
                    lower.append(old)
                    upper.append(above)
                    upper[old] = new
                    lower[above] = new  # the top group is final, so there is a group above
        now = lower[now]
    return [length[g] for g in of]


def _common(a: np.ndarray, i: int, j: int) -> int:
    """Longest common extension to the right of the places i < j."""
    n, at, step = len(a) - j, 0, 16
    while at < n:
        differ = np.flatnonzero(a[i + at : i + min(at + step, n)] != a[j + at : j + min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


def runs_of(s: list[int], least: int = LEAST) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``s``."""
    n, found = len(s), set()
    a = np.array(s, np.int64)
    back = a[::-1]
    for order in (s, [-x for x in s]):
        known: dict[int, tuple[int, int]] = {}  # period: the stretch equal to what lies a period on
        for i, p in enumerate(lyndon_lengths(order)):
            if i + p >= n and p > i:
                continue
            lo, hi = known.get(p, (0, -1))
            if lo <= i <= hi:
                continue
            r = _common(a, i, i + p) if i + p < n and s[i] == s[i + p] else 0
            l = _common(back, n - i - p, n - i) if i and s[i - 1] == s[i + p - 1] else 0
            known[p] = (i - l, i + r)
            if l + r >= p and l + r + p >= least:
                found.add((i - l, l + r + p, p))
    return found


def find(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs of a text's words, by start and period."""
    if len(words) < least:
        return []
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    half = (least + 1) // 2
    if len(known) > len(words) - half:
        return []
    t = W.windows(W.mix(ids.astype(np.uint64) + W._K1), half)
    order = np.sort(t)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return []
    at = np.searchsorted(twice, t)
    again = twice[np.minimum(at, len(twice) - 1)] == t
    step = np.zeros(len(ids) + 1, np.int64)
    step[: len(t)] += again
    step[half:] -= again
    edge = np.diff(np.concatenate([[0], np.cumsum(step[:-1]) > 0, [0]]).astype(np.int8))
    out = []
    for lo, hi in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        if hi - lo >= least:
            out += [(int(lo) + s, n, p) for s, n, p in runs_of(ids[lo:hi].tolist(), least)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        step[s + p] += 1
        step[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs (start, length, period, by start
    and period; places are word numbers from 0) and collapsed, the text's words
    without the repetitions, joined by one space."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    run = pa.struct([(x, pa.int64()) for x in RUN.names])

    def search(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            size = W.utf8(texts)[1]
            for a, b in W.slices(batch.num_rows, size):
                n, runs, rest = [], [], []
                for t in texts.slice(a, b - a):
                    w = (t.as_py() or "").encode().split()  # at [\x20\x09-\x0D]
                    found = find(w, least)
                    n.append(len(w))
                    runs.append([dict(zip(RUN.names, x)) for x in found])
                    rest.append(b" ".join(collapse(w, found)).decode())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(rest, pa.string())], names=schema.names)

    return rows.mapInArrow(search, schema)
