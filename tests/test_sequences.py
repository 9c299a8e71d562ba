"""Steps of O31, O36 and O37 inside a task, against the joins for hot keys and plain Python."""

import os
import random

import numpy as np
import pytest

from ballot import session
from ballot.operators import candidates as C
from ballot.operators import prepare as P
from ballot.operators import propagate as PG
from ballot.operators import sequences as S
from ballot.operators.weights import weights_frame
from ballot.plans import ensemble as PL
from ballot.plans import files
from ballot.plans.registry import QUERIES
from ballot.schema import PREDICTIONS
from ballot.sources.io import read_predictions


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("far", [1, 2**40])
def test_rows_are_sorted_as_one_number_or_by_column(far):
    rng = random.Random(1)
    rows = [(rng.randrange(5) * far, rng.randrange(4) * far, rng.randrange(3)) for _ in range(200)]
    got = S.in_order(*(np.array(c, np.int64) for c in zip(*rows)))
    assert list(zip(*(c.tolist() for c in got))) == sorted(rows)
    assert [len(c) for c in S.in_order(*[np.zeros(0, np.int64)] * 3)] == [0, 0, 0]


@pytest.mark.parametrize("step", [1, 2**40, -(2**40)])
@pytest.mark.parametrize("make", [C.graph_propagate, C.coborrow_candidates, C.coborrow_pairs])
def test_links_of_near_far_negative_and_null_keys(spark, make, step, monkeypatch):
    rng = random.Random(9)
    key = lambda n: rng.choice([None, *range(n)])
    far = lambda k: None if k is None else k * step
    rows = [(far(key(8)), far(key(12)), rng.choice([None, 1, 2]), rng.choice([None, 1, 2])) for _ in range(150)]
    train = spark.createDataFrame(rows, "user_id long, book_id long, ts long, seq long")
    monkeypatch.setattr(S, "CHUNK", 7)
    plain = make(train)
    if make is not C.coborrow_candidates:  # its lists are read back from their file
        assert "MapInArrow" in _plan(plain) and "Window" not in _plan(plain)
    want = _rows(make(train, hot_rows=1))
    assert want and _rows(plain) == want
    assert _rows(make(train.limit(0))) == []


def test_pairs_are_counted_as_in_plain_python(spark):
    rng = random.Random(4)
    seqs = {u: rng.sample(range(30), rng.randrange(1, 20)) for u in range(40)}
    train = spark.createDataFrame([(u, b, t) for u, bs in seqs.items() for t, b in enumerate(bs)], "user_id long, book_id long, ts long")
    counts = {}
    for bs in seqs.values():
        for i, b1 in enumerate(bs):
            for b2 in bs[max(0, i - 3) : i] + bs[i + 1 : i + 4]:
                counts[b1, b2] = counts.get((b1, b2), 0) + 1
    want = set()
    for b1 in range(30):
        mine = sorted((-n, b2) for (b, b2), n in counts.items() if b == b1)
        want |= {(b1, b2, -n) for n, b2 in mine[:6]}
    assert {tuple(r) for r in C.coborrow_pairs(train, window=3, neighbours=6).collect()} == want


def test_parts_fill_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert C._parts(spark.range(1), cores * C.BORROWS_EACH + 1) == 2 * cores


def test_blend_deals_the_lists_once(spark):
    rows = [(m, "f", u, (u or 0) * 3 % 7 + r, 1.0, r) for m in ("a", "b") for u in (1, 2, 3, None) for r in range(1, 5 + len(m))]
    lists = [spark.createDataFrame([r for r in rows if r[0] == m], PREDICTIONS) for m in ("a", "b")]
    weights = weights_frame(spark, [("a", 300, 1, "backbone"), ("b", 200, 2, "aux")])
    text = _plan(C.hybrid_candidates(lists, weights, k=3))
    assert text.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in text
    with pytest.raises(ValueError, match="without a weight"):
        C.hybrid_candidates(lists, weights.filter("model = 'a'"), k=3)


def _stages(spark, name):
    base = session.checkpoint_dir(spark).removeprefix("file:")
    return {n for n in os.listdir(base) if n.startswith(f"ballot-{name}-")}


def test_both_depths_read_one_propagation(spark):
    before = _stages(spark, "pool"), _stages(spark, "layer")
    QUERIES["o31_graph_layers"](spark, "/root/testdata/sf0.001")
    # the candidates once; the books before the first of three layers, users and books after each
    assert len(_stages(spark, "pool") - before[0]) == 1 and len(_stages(spark, "layer") - before[1]) == 7


def test_shared_propagation_gives_the_same_lists(spark):
    rng = random.Random(2)
    train = spark.createDataFrame([(rng.randrange(9), rng.randrange(14), t) for t in range(120)], "user_id long, book_id long, ts long")
    items = spark.createDataFrame([(b, [rng.random() for _ in range(4)]) for b in range(11)], "book_id long, embedding array<float>")
    shared = PG.propagation(train, items, 4, 3, pool=6)
    for n in (2, 3):
        assert _rows(PG.graph_layers(train, items, 4, n, 4, 6, shared=shared)) == _rows(PG.graph_layers(train, items, 4, n, 4, 6))
    with pytest.raises(ValueError, match="3 layers shared"):
        PG.graph_layers(train, items, 4, 4, 4, 6, shared=shared)


def test_lists_of_one_family_are_conformed_without_it(spark, tmp_path):
    rows = [(u, (u or 0) * r % 5, float(r)) for u in (1, 2, 3, None) for r in range(4)]
    for m in ("a1", "a2", "b"):
        spark.createDataFrame(rows, "user_id long, book_id long, raw_score double").write.option("header", True).csv(f"{tmp_path}/{m}")
    sources = [(m, m[0], f"{tmp_path}/{m}") for m in ("a1", "a2", "b")]
    out = files.read_lists(spark, sources, list_bound=4, rows=4)
    assert "SortAggregate" not in _plan(out)
    assert _rows(out) == _rows(P.conform(read_predictions(spark, sources), list_bound=4))

    train = spark.sql("SELECT id % 11 user_id, id % 17 book_id, TIMESTAMP_NTZ'2020-01-01 00:00:00' ts, id seq FROM range(60)")
    items = spark.createDataFrame([(b, [1.0 + b, 2.0]) for b in range(6)], "book_id long, embedding array<float>")
    users = spark.createDataFrame([(u, "g") for u in range(11)], "user_id long, grp string")
    lists = PL.candidate_lists(train, items, users, 3)
    assert not any("SortAggregate" in _plan(x) for x in lists)
    assert [{r["family"] for r in x.collect()} for x in lists] == [{f} for f in ("popular", "history", "coborrow", "graph", "emb", "emb", "emb")]


def test_books_without_a_vector_go_before_the_shuffle(spark, monkeypatch):
    train = spark.sql("SELECT nullif(id % 5, 4) user_id, nullif(id % 7, 6) book_id FROM range(60)")
    items = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, -1.0]), (3, None), (None, [1.0, 1.0])], "book_id long, embedding array<float>")
    out = C.embedding_variant(items, train, 2)
    assert "LeftSemi" in _plan(out)
    want = _rows(out)
    monkeypatch.setattr(C, "MAX_BROADCAST_ROWS", 1)
    plain = C.embedding_variant(items, train, 2)
    assert "LeftSemi" not in _plan(plain) and want and _rows(plain) == want


def test_full_run_takes_the_holdout_and_bounds_its_lists(spark):
    rng = random.Random(7)
    inter = spark.createDataFrame([(rng.randrange(12), rng.randrange(9), t, t) for t in range(150)], "user_id long, book_id long, t int, seq long")
    inter = inter.selectExpr("user_id", "book_id", "timestamp_ntz '2020-01-01 00:00:00' + make_dt_interval(t) ts", "seq")
    books = spark.createDataFrame([(b,) for b in range(9)], "book_id long")
    items = spark.createDataFrame([(b, [rng.random() for _ in range(64)]) for b in range(8)], "book_id long, embedding array<float>")
    users = spark.createDataFrame([(u, "gh"[u % 2]) for u in range(12)], "user_id long, grp string")
    names = [("v5_a", "v5"), ("v5_b", "v5"), ("x", "x")]
    planted = P.conform(spark.createDataFrame([(m, f, u, (u * 3 + r * r) % 9, float(-r)) for m, f in names for u in range(12) for r in range(4)], "model string, family string, user_id long, book_id long, raw_score double"), list_bound=4)
    weights = weights_frame(spark, [(m, 100 + i, i, "backbone") for i, (m, _) in enumerate(names)])
    run = lambda **kw: PL.full_run(planted, inter, items, users, weights, aux=["x"], cap=50, books=books, **kw).collect()
    want = sorted(map(str, run()))
    base = session.scratch_path(spark, "holdout")
    holdout = PL.stage_holdout(inter, base)
    work = session.scratch_path(spark, "full-run")
    assert want and sorted(map(str, run(holdout=holdout, list_bound=4, rows=144, work_dir=work))) == want
    assert {"truth", "train"}.isdisjoint(os.listdir(work.removeprefix("file:")))
