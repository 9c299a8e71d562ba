"""Steps of O31 and O36 inside a task: borrows of a partition as NumPy arrays.

Spark deals the borrows by user or book to partitions numbered by the borrows, and
sorts them; a step here takes one such partition (``mapInArrow``), so a task holds
about ``BORROWS_EACH`` borrows and at most one user or book more, whatever the input.
Keys are longs; a null key is a key of its own that has no neighbours, and a null
book can be a neighbour like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ballot.schema import BOOK, RAW, RNK, USER

#: Borrows whose neighbours are put in one Arrow batch.
CHUNK = 20_000

Batches = Iterable[pa.RecordBatch]


def _whole(batches: Batches) -> pa.Table | None:
    some = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(some).combine_chunks() if some else None


def _flat(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _numbers(column) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 for a null) and which are null."""
    array = _flat(column)
    return pc.fill_null(array, 0).to_numpy(zero_copy_only=False).astype(np.int64), array.is_null().to_numpy(zero_copy_only=False)


def _lists(column) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists (0 for a null) and their values."""
    array = _flat(column)
    return pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64), array.flatten()


def _codes(values: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], pa.Array]]:
    """Numbers from 1 in the order of the values, 0 for a null, and the way back."""
    some = values[~null]
    low, high = (int(some.min()), int(some.max())) if len(some) else (0, 0)
    if high - low < 1 << 31:
        codes = np.where(null, 0, values - low + 1) if null.any() else values - low + 1
        return codes, lambda c: pa.array(c + (low - 1), pa.int64(), mask=c == 0)
    known, codes = np.unique(some, return_inverse=True)
    out = np.zeros(len(values), np.int64)
    out[~null] = codes + 1
    return out, lambda c: pa.array(known[np.maximum(c, 1) - 1], pa.int64(), mask=c == 0)


def in_order(*columns: np.ndarray) -> list[np.ndarray]:
    """The rows of columns of whole numbers from 0 on, sorted by all columns: as one
    number a row where their bits fit in 63."""
    bits = [int(c.max()).bit_length() if len(c) else 0 for c in columns]
    if sum(bits) > 63:
        order = np.lexsort(columns[::-1])
        return [c[order] for c in columns]
    key = columns[0].astype(np.int64)
    for c, n in zip(columns[1:], bits[1:]):
        key = (key << n) | c
    key.sort()
    out = []
    for n in bits[:0:-1]:
        out.append(key & ((1 << n) - 1))
        key = key >> n
    return [key, *out[::-1]]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where the rows of sorted columns change, the first row included."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first and the end of its key's rows; none for a null key."""
    first = _starts(codes)
    lengths = np.diff(np.append(first, len(codes)))
    start, end = np.repeat(first, lengths), np.repeat(first + lengths, lengths)
    end[codes == 0] = 0
    return start, end


def _places(window: int) -> np.ndarray:
    return np.array([j for j in range(-window, window + 1) if j])


def _near(start: np.ndarray, end: np.ndarray, rows: slice, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows at most ``window`` places from each of ``rows``, and which of them are of the same key."""
    at = np.arange(rows.start, rows.stop)[:, None] + _places(window)
    ok = (at >= start[rows][:, None]) & (at < end[rows][:, None])
    return np.where(ok, at, 0), ok


def _listed(values: np.ndarray, ok: np.ndarray, kind: pa.DataType, null: np.ndarray | None = None) -> pa.ListArray:
    """A list of the ``ok`` values a row."""
    offsets = np.append(0, ok.sum(axis=1).cumsum()).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values[ok], kind, mask=None if null is None else null[ok]))


def _chunks(n: int) -> Iterator[slice]:
    return (slice(i, min(n, i + CHUNK)) for i in range(0, n, CHUNK))


def _ranked(c1: np.ndarray, c2: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` rows of each c1 with the highest scores, then the lowest c2; with their ranks from 1."""
    top = int(score.max()) if len(score) else 0
    c1, rest, c2 = in_order(c1, top - score, c2)
    first = _starts(c1)
    rank = np.arange(len(c1)) - np.repeat(first, np.diff(np.append(first, len(c1)))) + 1
    kept = rank <= k
    return c1[kept], c2[kept], top - rest[kept], rank[kept]


# ------------------------------------------------------------------- steps


def sequences(batches: Batches) -> Iterator[pa.RecordBatch]:
    """(user, book) sorted by user and place -> one row a user: user, _books."""
    if (table := _whole(batches)) is not None:
        codes, back = _codes(*_numbers(table[USER]))
        first = _starts(codes)
        lists = pa.ListArray.from_arrays(np.append(first, len(codes)).astype(np.int32), _flat(table[BOOK]))
        yield pa.RecordBatch.from_arrays([back(codes[first]), lists], [USER, "_books"])


def links(window: int) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """(user, _books) -> for each borrow that has any: b1 and the books ``_b2`` at most ``window`` places away."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, flat = _lists(batch.column("_books"))
            _, unknown = _numbers(batch.column(USER))
            ends = lengths.cumsum()
            end = np.repeat(np.where(unknown, 0, ends), lengths)
            start = np.repeat(ends - lengths, lengths)
            book, null = _numbers(flat)
            for rows in _chunks(len(book)):
                at, ok = _near(start, end, rows, window)
                some = ok.any(axis=1)
                b1 = pa.array(book[rows][some], pa.int64(), mask=null[rows][some])
                yield pa.RecordBatch.from_arrays([b1, _listed(book[at[some]], ok[some], pa.int64(), null[at[some]])], ["b1", "_b2"])

    return run


def neighbours(most: int) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """(b1, _b2) of all links of some books -> b1 with its ``most`` most linked books and their counts."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        if (table := _whole(batches)) is not None:
            b1, back1 = _codes(*_numbers(table["b1"]))
            lengths, flat = _lists(table["_b2"])
            b2, back2 = _codes(*_numbers(flat))
            b1, b2 = in_order(np.repeat(b1, lengths), b2)
            first = _starts(b1, b2)
            b1, b2, count, _ = _ranked(b1[first], b2[first], np.diff(np.append(first, len(b1))), most)
            start = _starts(b1)
            offsets = np.append(start, len(b1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (back2(b2), pa.array(count, pa.int64()))]
            yield pa.RecordBatch.from_arrays([back1(b1[start]), *lists], ["b1", "_b2", "_cnt"])

    return run


def best(k: int, own: bool) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """(user, _b2, _w[, _own]) of all borrows of some users -> each user's ``k`` books with the
    highest sums of ``_w``, ties by book; without those that are ``_own`` for the user."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        if (table := _whole(batches)) is None:
            return
        codes, back1 = _codes(*_numbers(table[USER]))
        known, user = np.unique(codes, return_inverse=True)  # few, so that they need few bits
        lengths, flat = _lists(table["_b2"])
        book, null = _numbers(flat)
        weight, _ = _numbers(_lists(table["_w"])[1])
        users = np.repeat(user, lengths)
        if own:  # a mark weighs 0, any other row more, so the mark of a pair comes first
            mine, none = _numbers(table["_own"])
            users, book = np.concatenate([users, user[~none]]), np.concatenate([book, mine[~none]])
            null, weight = (np.concatenate([x, np.zeros((~none).sum(), x.dtype)]) for x in (null, weight))
        book, back2 = _codes(book, null)
        users, book, weight = in_order(users, book, weight)
        if not len(users):
            return
        first = _starts(users, book)
        score, kept = np.add.reduceat(weight, first), weight[first] > 0
        users, book, score, rank = _ranked(users[first][kept], book[first][kept], score[kept], k)
        columns = [back1(known[users]), back2(book), pa.array(score.astype(np.float64)), pa.array(rank.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, [USER, BOOK, RAW, RNK])

    return run


def _weights(window: int) -> np.ndarray:
    return window + 1 - np.abs(_places(window))


def books_beside(window: int) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """Borrows sorted by user and place, with ``_b2``, the books at most ``window`` places
    away in the user's sequence, and their weights ``_w``."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        if (table := _whole(batches)) is not None:
            start, end = _runs(_codes(*_numbers(table[USER]))[0])
            book, null = _numbers(table[BOOK])
            for rows in _chunks(len(book)):
                at, ok = _near(start, end, rows, window)
                part = table.slice(rows.start, rows.stop - rows.start)
                lists = [_listed(book[at], ok, pa.int64(), null[at]), _listed(np.broadcast_to(_weights(window), ok.shape), ok, pa.int32())]
                yield pa.RecordBatch.from_arrays([*map(_flat, part.columns), *lists], [*part.column_names, "_b2", "_w"])

    return run


def paths(window: int) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """Borrows (user, book, _b2, _w) sorted by book and place -> for each borrow that has any:
    the user, the ``_b2`` of the borrows at most ``window`` places away in the book's sequence,
    and the products ``_w`` of both weights."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        if (table := _whole(batches)) is None:
            return
        start, end = _runs(_codes(*_numbers(table[BOOK]))[0])
        lengths, flat = _lists(table["_b2"])
        book, null = _numbers(flat)
        weight, _ = _numbers(_lists(table["_w"])[1])
        if not len(book):
            return
        begin, each = lengths.cumsum() - lengths, np.arange(int(lengths.max()))
        for rows in _chunks(len(start)):
            at, ok = _near(start, end, rows, window)
            n = np.where(ok, lengths[at], 0)
            some = n.any(axis=1)
            at, n = at[some], n[some]
            has = each < n[:, :, None]
            place = np.where(has, begin[at][:, :, None] + each, 0)
            product = weight[place] * _weights(window)[:, None]
            has, place, product = (x.reshape(len(at), len(_places(window)) * len(each)) for x in (has, place, product))
            users = _flat(table[USER].slice(rows.start, rows.stop - rows.start)).filter(pa.array(some))
            yield pa.RecordBatch.from_arrays([users, _listed(book[place], has, pa.int64(), null[place]), _listed(product, has, pa.int32())], [USER, "_b2", "_w"])

    return run
