"""Operator 11: the n-gram Jaccard join by prefix trees."""

import random
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import DOC, SF_SMALL, VOCAB, awkward, clashing, empty, near_rows  # noqa: F401

import __spark_entry__ as entry
from ballot.llm import ngram_join


def brute_sets(rows, size):
    out = {}
    for d, t in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        out[d] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    return out


def brute_join(rows, size=4, num=85, den=100):
    sets, inv = brute_sets(rows, size), {}
    for d, x in sets.items():
        for g in x:
            inv.setdefault(g, []).append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for d, x in sets.items():
        for o, k in Counter(o for g in x for o in inv[g] if o < d).items():
            if den * k >= num * (len(x) + len(sets[o]) - k):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
    return {(d, len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("num", "den"), [(85, 100), (1, 2), (4, 5), (1, 1)])
def test_walk_finds_exactly_the_linked_sets(num, den):
    rng = np.random.default_rng(num)
    for _ in range(60):
        base = rng.choice(5000, int(rng.integers(1, 300)), replace=False)
        sets = []
        for _ in range(40):
            keep = base[rng.random(len(base)) > rng.choice([0, 0.02, 0.1, 0.5])]
            more = rng.choice(5000, int(rng.integers(0, 1 + len(base) // 8)), replace=False)
            sets.append(np.union1d(keep, more).astype(np.int64))
        sets = [s for s in sets if len(s)]
        order = rng.permutation(5000)  # any total order will do
        paths = [s[np.argsort(order[s])] for s in sets]
        at = sorted(range(len(paths)), key=lambda i: paths[i].tolist())
        query = base[np.argsort(order[base])].astype(np.int64)
        walk = ngram_join.Walk(query, num, den)
        for i in at:
            both = len(np.intersect1d(sets[i], base))
            assert walk.links(paths[i]) == (den * both >= num * (len(sets[i]) + len(base) - both))


def test_join_equals_brute_force(spark, near_rows):
    docs = spark.createDataFrame(near_rows, DOC)
    rows = [(r[0], r[1]) for r in near_rows]
    for size, num, den in ((4, 85, 100), (1, 3, 5), (2, 1, 1)):
        got = ngram_join.ngram_join(docs, size=size, num=num, den=den, buckets=512)
        assert {tuple(r) for r in got.collect()} == brute_join(rows, size, num, den)


def test_a_hot_group_and_a_common_passage(spark):
    """Near copies of one text, and other texts that share a long passage."""
    rng = random.Random(4)
    base, passage = [rng.choice(VOCAB) for _ in range(120)], [rng.choice(VOCAB) for _ in range(40)]
    rows = []
    for i in range(700):
        if i % 2:
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
        else:
            w = [rng.choice(VOCAB) for _ in range(rng.randint(0, 15))] + passage
        rows.append((i, " ".join(w), "en", "a", 1))
    got = ngram_join.ngram_join(spark.createDataFrame(rows, DOC))
    assert {tuple(r) for r in got.collect()} == brute_join([r[:2] for r in rows])


def test_chain_of_copies(spark):
    """Each text links with the next only; ids fall along the chain."""
    rng = random.Random(6)
    w = [rng.choice(VOCAB) for _ in range(100)]
    rows = []
    for i in range(30):
        rows.append((100 - i, " ".join(w), "en", "a", 1))
        w = list(w)
        w[(i * 3) % 100] = f"new{i}"
    got = {tuple(r) for r in ngram_join.ngram_join(spark.createDataFrame(rows, DOC)).collect()}
    assert got == brute_join([r[:2] for r in rows]) and len({c for _, _, c in got}) == 1


def test_join_of_awkward_rows(spark, awkward, clashing, empty):
    for docs in (awkward, clashing):
        rows = ngram_join.ngram_join(docs).collect()
        assert len(rows) == docs.count()
        assert [r.component_id for r in rows if r.doc_id is None] == [None]
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id in (1, 2, 3)} == {(1, 0, 1), (2, 0, 2), (3, 0, 3)}
        assert {r.component_id for r in rows if r.doc_id in (6, 7, 8)} == {6}
        assert {r.component_id for r in rows if r.doc_id == 9} == {9}
    assert ngram_join.ngram_join(empty).count() == 0


def test_join_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = entry.queries()["op11_ngram_jaccard_join"](spark, SF_SMALL)
    assert {tuple(r) for r in got.collect()} == brute_join([tuple(r) for r in rows])
