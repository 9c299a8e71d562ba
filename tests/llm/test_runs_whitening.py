"""Operators 12 and 13: periodic runs and embedding whitening."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from llm_fixtures import SF_SMALL, awkward, clashing, empty  # noqa: F401

import __spark_entry__ as entry
from ballot.llm import periodic, whitening


# ------------------------------------------------------------ periodic runs


def brute_lyndon(s):
    return [max(n for n in range(1, len(s) - i + 1) if all(s[i : i + n] < s[i + k : i + n] for k in range(1, n))) for i in range(len(s))]


def brute_runs(s, least):
    out = set()
    for p in range(1, len(s) // 2 + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            n = j - i + p
            if n >= max(2 * p, least) and not any(s[i : i + n - q] == s[i + q : i + n] for q in range(1, p)):
                out.add((i, n, p))
            i = max(j, i + 1)
    return out


def test_lyndon_arrays_and_runs_of_short_sequences():
    rng = random.Random(1)
    for _ in range(3000):
        s = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 20))]
        assert periodic.lyndon_lengths(s) == brute_lyndon(s)
        assert periodic.runs_of(s, 2) == brute_runs(s, 2)


def test_runs_of_texts():
    rng = random.Random(2)
    for _ in range(800):
        s = []
        while len(s) < rng.randint(1, 120):
            s += [rng.randrange(5) for _ in range(rng.randint(1, 9))] * rng.randint(1, 6)
        assert periodic.find([b"%d" % x for x in s]) == sorted(brute_runs(s, 12), key=lambda r: (r[0], r[2]))


def test_runs_of_long_texts():
    assert periodic.find([b"a"] * 50_000) == [(0, 50_000, 1)]
    words = [b"%d" % i for i in range(5_000)]
    assert periodic.find(words * 3 + words[:10]) == [(0, 15_010, 5_000)]
    fib = ["a", "b"]
    while len(fib[-1]) < 3_000:
        fib.append(fib[-1] + fib[-2])
    assert periodic.runs_of([ord(c) for c in fib[-1][:400]], 2) == brute_runs([ord(c) for c in fib[-1][:400]], 2)


def test_collapsed_words():
    words = "x y a b a b a b a b a b a b z".split()
    assert periodic.find(words) == [(2, 12, 2)]
    assert periodic.collapse(words, periodic.find(words)) == "x y a b z".split()


def brute_periodic(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(words, 12), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    rest = b" ".join(w for i, w in enumerate(words) if i not in gone)
    every = "".join(f"{s},{k},{p}\n" for s, k, p in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(every.encode()).hexdigest(), hashlib.sha256(rest).hexdigest(), n)


def test_periodic_query_equals_brute_force(spark):
    got = entry.queries()["op12_periodic_runs"](spark, SF_SMALL)
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in rows if len((r.text or "").split()) < 1500}  # the brute force is quadratic
    assert got.count() == len(rows) and len(short) > 0.9 * len(rows)
    want = {brute_periodic(d, t) for d, t in short.items()}
    assert {tuple(r) for r in got.collect() if r.doc_id in short} == want


def test_periodic_awkward_rows(spark, awkward, clashing, empty):
    for docs in (awkward, clashing):
        rows = periodic.find_runs(docs).collect()
        assert len(rows) == docs.count()
        assert {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0} and {r.collapsed for r in rows if r.doc_id in (1, 2, 3)} == {""}
        assert [r.n_words for r in rows if r.doc_id == 4] == [1]
        assert all(r.runs == [] for r in rows if r.doc_id != 11)
    assert periodic.find_runs(empty).count() == 0
    text = spark.createDataFrame([("k", "é É " * 8)], "id string, body string")
    r = periodic.find_runs(text, "id", "body").first()
    assert r.doc_id == "k" and [tuple(x) for x in r.runs] == [(0, 16, 2)] and r.collapsed == "é É"


# --------------------------------------------------------------- whitening


@pytest.mark.parametrize("kind", range(5))
def test_leading_eigenpairs(kind):
    rng = np.random.default_rng(kind)
    for _ in range(30):
        d = int(rng.integers(1, 12))
        q, _ = np.linalg.qr(rng.standard_normal((d, d)))
        e = [rng.random(d), rng.integers(0, 3, d).astype(float), 10.0 ** -rng.integers(0, 12, d), np.ones(d), 1 + 1e-14 * rng.standard_normal(d)][kind]
        v = (q * e) @ q.T
        v = (v + v.T) / 2
        want, k, t = np.sort(np.linalg.eigvalsh(v))[::-1], min(4, d), rng.random()
        if np.abs(want - t).min() > 1e-9:
            assert whitening.inertia(v - t * np.eye(d)) == (want > t).sum()
        values, axes = whitening.leading(v, k)
        assert np.abs(values - want[:k]).max() < 1e-12
        assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-9 and np.abs(v @ axes - axes * values).max() < 1e-11


def brute_whiten(rows, k=4):
    """(vec_id, component) -> (n, deviation, |whitened|, explained), in exact sums."""
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    v = np.array([[float(Fraction(sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in fit), n**3)) for b in range(d)] for a in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = {}
    for i, x in good:
        w = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ u / np.sqrt(e)
        for c in range(k):
            out[i, c + 1] = (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), abs(w[c]), e[c] / np.trace(v))
    return out


def compare(rows, want):
    assert {(r.vec_id, r.component) for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        n, away, w, part = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, away)
        assert abs(abs(r.whitened) - w) < 1e-6 * max(1, w) and abs(r.explained - part) < 1e-9 and r.identity_error < 1e-9


def test_whitening_of_awkward_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(6)]) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (204, []), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id long, embedding array<double>, x string, component int")
    got = whitening.whiten(df).collect()
    compare(got, brute_whiten(rows))
    twice = whitening.whiten(df.unionByName(df)).collect()
    assert len(twice) == 2 * len(got) and {(r.vec_id, r.component, r.n, r.deviation) for r in twice} == {(r.vec_id, r.component, r.n, r.deviation) for r in got}


def test_whitening_without_directions(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(None, [0.5, 1.0]), (2, [0.75, 1.0]), (3, [1.5, 1.0])], schema)).collect()
    assert {(r.vec_id, r.component) for r in flat} == {(None, 1), (2, 1), (3, 1)} and flat[0].explained == 1.0


def test_whitening_of_huge_entries(spark):
    rows = [(1, [2.0**50, 0.0]), (2, [-(2.0**50), 1.0]), (3, [0.0, 2.0]), (4, [2.0**60, 0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=1).collect()
    assert {r.vec_id for r in got} == {1, 2, 3}  # the fourth is beyond the range of whole numbers
    assert {r.vec_id: r.deviation for r in got}[1] is None and got[0].identity_error < 1e-9


def test_whitening_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    compare(entry.queries()["op13_embedding_whitening"](spark, SF_SMALL).collect(), brute_whiten([tuple(r) for r in rows]))
