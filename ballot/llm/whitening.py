"""Embedding whitening by spectrum slicing (operator 13).

Vectors become whole numbers, x = floor(scale * c), and the fit list is every
distinct x vector once.  Spark reduces it to the count n, the sums S and the
covariance: sums of products of x - floor(S / n), which is small, so they are
exact; the rest of the centring, less than one a dimension, is taken out of the
sums in whole numbers.  Only these dim x dim sums reach the driver.

The leading eigenvalues come from spectrum slicing.  The LDL' factorisation of
V - t I has as many positive pivots as V has eigenvalues above t, so halving
intervals isolates each of them by counting.  From an isolating interval, an
inverse iteration and then Rayleigh quotient iteration converge cubically, and
counts just below and above the result certify its number; an iterate that left
its interval is halved on until it converges.  Eigenvalues that agree to within
rounding form a cluster: its vectors are iterated orthogonally to each other.

Whitening is a map over the rows; one more aggregate over the fit list measures
the largest difference between the whitened covariance and the identity.

Defined results: rows whose vector is null, empty or of another length than most
(of equally common lengths the greatest), or holds null or non-finite entries,
are dropped, as are those with an entry beyond 2**62 / scale; a null id is kept;
repeated rows return each, and count once in the fit list; components with a
variance below 10^-13 of the whole have no direction to scale and are not
returned, so fewer than ``k`` come back when the vectors span fewer dimensions,
and none at all from an empty table or from equal vectors.
``deviation`` is null where the exact sum exceeds a long.
"""

from __future__ import annotations

from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballot.llm.graph import staged

SCALE = 256
COMPONENTS = 4
#: Variance of a component, as a part of the whole, that counts as none.
RANK = 1e-13


# ------------------------------------------------------- eigenvalues by counts


def inertia(a: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix: positive pivots of
    its LDL' factorisation with complete pivoting (1 x 1 and 2 x 2 blocks)."""
    a, positive = a.copy(), 0
    bound = (1 + np.sqrt(17)) / 8
    while len(a):
        d = np.abs(np.diagonal(a))
        i = int(d.argmax())
        off = np.abs(a - np.diag(np.diagonal(a)))
        r, c = divmod(int(off.argmax()), len(a))
        if max(d[i], off[r, c]) == 0:
            return positive
        if d[i] >= bound * off[r, c]:
            positive += bool(a[i, i] > 0)
            rest = np.arange(len(a)) != i
            col = a[rest, i]
            a = a[np.ix_(rest, rest)] - np.outer(col, col) / a[i, i]
        else:  # an indefinite block: one positive, one negative
            positive += 1
            rest = np.ones(len(a), bool)
            rest[[r, c]] = False
            col = a[np.ix_(rest, [r, c])]
            a = a[np.ix_(rest, rest)] - col @ np.linalg.solve(a[np.ix_([r, c], [r, c])], col.T)
    return positive


def _above(v: np.ndarray, t: float) -> int:
    """Number of eigenvalues above ``t``."""
    return inertia(v - t * np.eye(len(v)))


def _slices(v: np.ndarray, k: int) -> list[list[float]]:
    """For each of the k largest eigenvalues an interval (lo, hi] that holds it
    and no other, or one of the width of rounding that holds a cluster."""
    radius = float(np.abs(v).sum(axis=1).max())
    tiny = 8 * np.finfo(float).eps * radius
    counts = {-radius - tiny: len(v), radius + tiny: 0}
    out = []
    for number in range(1, k + 1):
        lo = max(t for t, n in counts.items() if n >= number)
        hi = min(t for t, n in counts.items() if n < number)
        while (counts[lo] > number or counts[hi] < number - 1) and hi - lo > 2 * tiny:
            mid = (lo + hi) / 2
            counts[mid] = _above(v, mid)
            lo, hi = (mid, hi) if counts[mid] >= number else (lo, mid)
        out.append([lo, hi])
    return out


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit
    eigenvectors as columns."""
    d = len(v)
    values, vectors = np.zeros(k), np.zeros((d, k))
    radius = float(np.abs(v).sum(axis=1).max())
    if not radius:
        return values, np.eye(d, k)
    tiny = 8 * np.finfo(float).eps * radius
    start = np.random.default_rng(0).standard_normal((d, k))
    for number, (lo, hi) in enumerate(_slices(v, k), 1):
        done = vectors[:, : number - 1]
        near = done[:, np.abs(values[: number - 1] - (lo + hi) / 2) <= 1e-3 * radius]
        rho, x = (lo + hi) / 2, _unit(start[:, number - 1], done)
        for _ in range(200):
            y = _solve(v, rho, x, tiny)
            x = _unit(y, near if hi - lo > 4 * tiny else done)
            quotient = float(x @ v @ x)
            residual = float(np.linalg.norm(v @ x - quotient * x))
            if lo - tiny <= quotient <= hi + tiny and residual <= 64 * tiny:
                rho = quotient
                if _above(v, rho - 64 * tiny) >= number > _above(v, rho + 64 * tiny):
                    break
            if lo < quotient <= hi and residual < (hi - lo):
                rho = quotient  # inside its slice: the cubic step
            elif hi - lo > 4 * tiny:  # outside: halve the slice by one more count
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if _above(v, mid) >= number else (lo, mid)
                rho = (lo + hi) / 2
        values[number - 1], vectors[:, number - 1] = float(x @ v @ x), x
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _solve(v: np.ndarray, t: float, x: np.ndarray, tiny: float) -> np.ndarray:
    for shift in (t, t + tiny, t - 3 * tiny):
        try:
            y = np.linalg.solve(v - shift * np.eye(len(v)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all():
            return y
    return x


def _unit(y: np.ndarray, against: np.ndarray) -> np.ndarray:
    y = y / np.linalg.norm(y)
    for _ in range(2):
        y = y - against @ (against.T @ y)
        size = np.linalg.norm(y)
        if size < 1e-8:  # all of it was in the others
            y = np.eye(len(y))[int(np.argmin((against**2).sum(axis=1)))]
        else:
            y = y / size
    return y / np.linalg.norm(y)


# ----------------------------------------------------------------- the vectors


def whole_vectors(rows: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """``rows`` with a column ``x`` of whole numbers, without the rows that have none."""
    v = F.col(vector).cast("array<double>")
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**62 / scale)
    good = rows.filter((F.size(v) > 0) & F.forall(v, entry))
    whole = good.withColumn("x", F.transform(v, lambda c: F.floor(c * scale)))
    sizes = good.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    most = sizes.agg(F.max_by("d", F.struct("c", "d")))
    return whole.filter(F.size("x") == most.scalar())


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def _exact_products(x: np.ndarray) -> list[int]:
    """The upper triangle of x' x, exact."""
    at = np.triu_indices(x.shape[1])
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if top * top * len(x) < 2**53:
        return (x.astype(float).T @ x.astype(float))[at].astype(np.int64).tolist()
    whole = x.astype(object)
    return [int(n) for n in (whole.T @ whole)[at]]


def _long_sums(parts: DataFrame) -> dict[tuple[str, int], int]:
    """Exact sums of (kind, i, hi, lo) rows, value = hi * 2**62 + lo: a row for
    each kind and place, whatever the number of vectors."""
    sums = parts.groupBy("kind", "i").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("hi", "lo"))).collect()
    return {(r["kind"], r["i"]): int(r["hi"]) * 2**62 + int(r["lo"]) for r in sums}


_PART = "kind string, i int, hi decimal(38,0), lo long"


def _parts(kind: str, values: list[int]) -> pa.RecordBatch:
    n = len(values)
    hi = [Decimal(v >> 62) for v in values]
    return pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array(range(n), pa.int32()), pa.array(hi, pa.decimal128(38, 0)), pa.array([v & (2**62 - 1) for v in values], pa.int64())], names=["kind", "i", "hi", "lo"])


def _reduced(rows: DataFrame, of) -> dict[tuple[str, int], int]:
    """Exact sums over a column of vectors of what ``of`` yields: (kind, values)
    of a batch.  A task adds up its batches and emits one row a sum."""

    def run(batches):
        total: dict[str, list[int]] = {}
        for batch in batches:
            if batch.num_rows:
                for kind, values in of(_matrix(batch.column(0))):
                    total[kind] = [a + b for a, b in zip(total[kind], values)] if kind in total else values
        for kind, values in total.items():
            yield _parts(kind, values)

    return _long_sums(rows.mapInArrow(run, _PART))


def fit(vectors: DataFrame, k: int = COMPONENTS) -> dict | None:
    """The model of the distinct vectors ``x``: n, sums, eigenvalues, vectors
    (dim x k), explained; None without vectors."""

    def first(x):
        top = x.astype(object).sum(axis=0) if np.abs(x).max() > 2**62 // len(x) else x.sum(axis=0)
        return [("sum", [int(s) for s in top]), ("n", [len(x)])]

    got = _reduced(vectors.select("x"), first)
    if ("n", 0) not in got:
        return None
    n = got["n", 0]
    sums = [got["sum", i] for i in range(sum(kind == "sum" for kind, _ in got))]
    d, floor = len(sums), np.array([s // n for s in sums], np.int64)

    def second(x):
        # beyond longs only for entries near their own limit
        y = x - floor if max(abs(int(x.max())), abs(int(x.min()))) < 2**61 else x.astype(object) - floor.astype(object)
        return [("xx", _exact_products(y))]

    got = _reduced(vectors.select("x"), second)
    rest = [s - n * int(f) for s, f in zip(sums, floor)]
    v = np.zeros((d, d))
    for at, (i, j) in enumerate(zip(*np.triu_indices(d))):
        v[i, j] = v[j, i] = (n * got["xx", at] - rest[i] * rest[j]) / (n * n)
    trace = float(np.trace(v))
    k = min(k, d)
    values, axes = leading(v, k) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    some = values > RANK * trace
    return {"n": n, "sums": sums, "values": values[some], "axes": axes[:, some], "trace": trace}


def _whitened(x: np.ndarray, model: dict) -> np.ndarray:
    n, sums = model["n"], model["sums"]
    floor = np.array([s // n for s in sums], np.int64)
    part = np.array([(s - n * (s // n)) / n for s in sums])
    y = (x - floor).astype(float) - part
    return y @ model["axes"] / np.sqrt(model["values"])


def _identity_error(vectors: DataFrame, model: dict) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    k = len(model["values"])

    def run(batches):
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = _whitened(_matrix(batch.column(0)), model) if batch.num_rows else np.zeros((0, k))
            w = np.hstack([w, np.ones((len(w), 1))])
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "s"])

    rows = vectors.select("x").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((k + 1) ** 2)
    for r in rows:
        total[r["i"]] = r["s"]
    total = total.reshape(k + 1, k + 1) / model["n"]
    return float(np.abs(total[:k, :k] - np.outer(total[k, :k], total[k, :k]) - np.eye(k)).max())


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Per remaining row and component: vec_id, component, n, deviation,
    whitened, explained, identity_error."""
    ids = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    good = whole_vectors(ids, "v", scale).select("vec_id", "x")
    fit_list = staged(good.select("x").distinct(), "whiten-fit")
    model = fit(fit_list, k)
    schema = T.StructType([good.schema["vec_id"], *(T.StructField(c, t()) for c, t in (("component", T.IntegerType), ("n", T.LongType), ("deviation", T.LongType), ("whitened", T.DoubleType), ("explained", T.DoubleType), ("identity_error", T.DoubleType)))])
    if model is None or not len(model["values"]):
        return rows.sparkSession.createDataFrame([], schema)
    error, n, m = _identity_error(fit_list, model), model["n"], len(model["values"])
    sums, explained = np.array(model["sums"], object), model["values"] / model["trace"]
    reach = isqrt((2**63 - 1) // max(1, len(sums)))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            top = max(abs(int(x.max())), abs(int(x.min())))
            if n * top + max(abs(int(s)) for s in sums) <= reach:  # no square and no sum beyond a long
                away = ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                away = [int(a) if a < 2**63 else None for a in ((n * x.astype(object) - sums) ** 2).sum(axis=1)]
            w = _whitened(x, model)
            each = np.repeat(np.arange(len(x)), m)
            number = np.tile(np.arange(m), len(x))
            columns = [batch.column(0).take(pa.array(each)), pa.array((number + 1).astype(np.int32)), pa.array(np.full(len(each), n)), pa.array(away, pa.int64()).take(pa.array(each)), pa.array(w.ravel()), pa.array(explained[number]), pa.array(np.full(len(each), error))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return good.mapInArrow(run, schema)
