"""Micro fixtures (FIXTURES.md §4): hand-written inputs, expected rows by hand."""

import math
from datetime import datetime

import pytest
from conftest import preds_df, rows
from pyspark.sql import functions as F

from ballot.operators import candidates as C
from ballot.operators import evaluate as E
from ballot.operators import layer1 as L1
from ballot.operators import layer2 as L2
from ballot.operators import prepare as P
from ballot.operators import weights as W
from ballot.schema import AUX, BACKBONE, to_micro


def weights(spark, pairs, roles=None):
    roles = roles or {}
    return W.weights_frame(
        spark, [(m, to_micro(w), i + 1, roles.get(m, BACKBONE)) for i, (m, w) in enumerate(pairs)]
    )


# ------------------------------------------------------------------ O05


def test_conform_duplicates(spark):
    df = preds_df(spark, [("a", 1, 10, 0.5), ("a", 1, 10, 0.9), ("a", 1, 11, 0.7)])
    assert rows(P.conform(df), "book_id", "raw_score", "rnk") == [(10, 0.9, 1), (11, 0.7, 2)]


def test_conform_bad_rows(spark):
    df = preds_df(spark, [("a", 1, None, 0.5), ("a", None, 10, 0.5), ("a", 1, 10, float("nan"))])
    assert rows(P.conform(df), "user_id", "book_id", "raw_score", "rnk") == [(1, 10, None, 1)]


def test_conform_infinite_scores_become_null(spark):
    df = preds_df(spark, [("a", 1, 10, float("inf")), ("a", 1, 11, 0.1)])
    assert rows(P.conform(df), "book_id", "raw_score", "rnk") == [(10, None, 2), (11, 0.1, 1)]


def test_conform_ties_by_book(spark):
    df = preds_df(spark, [("a", 1, 12, 0.5), ("a", 1, 11, 0.5)])
    assert rows(P.conform(df), "rnk", "book_id") == [(1, 11), (2, 12)]


def test_conform_given_rank_decides(spark):
    df = preds_df(spark, [("a", 1, 10, 0.9, 2), ("a", 1, 11, 0.1, 1)], with_rank=True)
    assert rows(P.conform(df), "rnk", "book_id") == [(1, 11), (2, 10)]


def test_conform_idempotent(spark):
    df = preds_df(spark, [("a", 1, 12, 0.5), ("a", 1, 11, 0.5), ("a", 1, 10, 0.7), ("b", 2, 3, None)])
    once = P.conform(df)
    assert rows(P.conform(once)) == rows(once)


def test_empty_input_keeps_schema(spark):
    df = preds_df(spark, [])
    out = P.conform(df)
    assert out.count() == 0
    assert out.columns == ["model", "family", "user_id", "book_id", "raw_score", "rnk"]
    votes = L2.weighted_vote(out, weights(spark, [("a", 0.5)]), validate=False)
    assert votes.count() == 0 and L2.top1(votes).count() == 0


# ------------------------------------------------------------------ O06


def test_standardize_constant_file(spark):
    df = P.conform(preds_df(spark, [("a", 1, 10, 3.0), ("a", 2, 11, 3.0)]))
    assert {r.std_score for r in P.standardize(df, "minmax").collect()} == {1.0}
    assert {r.std_score for r in P.standardize(df, "zscore").collect()} == {0.0}


def test_standardize_range(spark):
    df = P.conform(preds_df(spark, [("a", 1, 10, 0.0), ("a", 1, 11, 5.0), ("a", 1, 12, 10.0)]))
    assert rows(P.standardize(df, "minmax"), "book_id", "std_score") == [(10, 0.0), (11, 0.5), (12, 1.0)]
    got = rows(P.standardize(df, "rank"), "book_id", "std_score")
    assert [b for b, _ in got] == [10, 11, 12]
    assert [round(s, 12) for _, s in got] == [round(1 / 3, 12), round(2 / 3, 12), 1.0]


def test_standardize_zscore_matches_numpy(spark):
    import numpy as np

    vals = [0.0, 1.0, 3.0, 7.5]
    df = P.conform(preds_df(spark, [("a", 1, 10 + i, v) for i, v in enumerate(vals)]))
    got = dict(rows(P.standardize(df, "zscore"), "raw_score", "std_score"))
    arr = np.array(vals)
    for v in vals:
        assert math.isclose(got[v], (v - arr.mean()) / arr.std(), rel_tol=1e-12)


def test_standardize_null_in_null_out(spark):
    df = P.conform(preds_df(spark, [("a", 1, 10, None), ("a", 1, 11, 2.0), ("a", 1, 12, 4.0)]))
    got = dict(rows(P.standardize(df, "minmax"), "book_id", "std_score"))
    assert got[10] is None and got[12] == 1.0


# ------------------------------------------------------------------ O07


def test_calibrate_bins(spark):
    df = P.conform(preds_df(spark, [("a", 1, 10, 1.0), ("a", 1, 11, 0.0), ("a", 2, 10, 1.0)]))
    truth = spark.createDataFrame([(1, 10)], "user_id long, book_id long")
    got = rows(P.calibrate(df, truth, "bins", 2), "user_id", "book_id", "cal_score")
    out = {(u, b): s for u, b, s in got}
    # user 1 is the only validation user: bin 1 (score 1.0) has 1 hit of 1 row
    assert out[(1, 10)] == pytest.approx(2 / 3)
    assert out[(1, 11)] == pytest.approx(1 / 3)
    assert out[(2, 10)] == pytest.approx(2 / 3)


# ------------------------------------------------------------------ O08 / O09 / O12


def test_model_weights_skipped_user(spark):
    df = P.conform(preds_df(spark, [("a", 1, 10, 1.0)]))
    truth = spark.createDataFrame([(1, 10), (2, 20)], "user_id long, book_id long")
    r = W.model_weights(df, truth).collect()[0]
    assert (r.hits, r.n_users, r.weight, r.priority) == (1, 2, 500_000, 1)


def test_cap_weights(spark):
    w = W.weights_frame(
        spark, [("b", 900_000, 1, BACKBONE), ("x", 300_000, 2, AUX), ("y", 100_000, 3, AUX)]
    )
    assert rows(W.cap_weights(w, 200_000), "model", "weight") == [("b", 900_000), ("x", 200_000), ("y", 100_000)]
    assert rows(W.cap_weights(w, 200_000, 150_000), "model", "weight") == [
        ("b", 900_000),
        ("x", 100_000),
        ("y", 50_000),
    ]


def test_attach_weights_unknown_model(spark):
    df = P.conform(preds_df(spark, [("a", 1, 10, 1.0), ("zz", 1, 10, 1.0)]))
    with pytest.raises(ValueError):
        W.attach_weights(df, weights(spark, [("a", 0.5)]))


def test_attach_weights_unknown_model_lazy_check_fails_the_job(spark):
    df = P.conform(preds_df(spark, [("a", 1, 10, 1.0), ("zz", 1, 10, 1.0)]))
    joined = W.attach_weights(df, weights(spark, [("a", 0.5)]), validate="lazy")
    with pytest.raises(Exception, match="model without a weight"):
        joined.collect()
    ok = W.attach_weights(df.filter(F.col("model") == "a"), weights(spark, [("a", 0.5)]), validate="lazy")
    assert rows(ok, "model", "weight") == [("a", 500_000)]


# ------------------------------------------------------------------ O10 / O13 / O14 / O15


def test_support_filter_threshold(spark):
    data = []
    for book, support in ((10, 6), (11, 7), (12, 8)):
        data += [(f"m{i}", 1, book, 1.0) for i in range(support)]
    df = P.conform(preds_df(spark, data)).withColumn("family", F.lit("f"))
    assert rows(L1.support_filter(df, "f", min_support=7), "book_id", "support") == [(11, 7), (12, 8)]


def test_supplementary(spark):
    new = P.conform(preds_df(spark, [("n", 1, 10, 2.0), ("n", 1, 11, 1.0)]))
    bb = P.conform(preds_df(spark, [("b", 1, 10, 1.0)]))
    assert rows(E.supplementary(new, bb, 10), "book_id") == [(11,)]


def test_cascade_order(spark):
    s1 = spark.createDataFrame([(1, 10, 5)], "user_id long, book_id long, score long")
    s2 = spark.createDataFrame([(1, 20, 1), (2, 21, 1)], "user_id long, book_id long, score long")
    out = rows(L2.cascade([("one", s1), ("two", s2)]), "user_id", "book_id", "source")
    assert out == [(1, 10, "one"), (2, 21, "two")]


def test_variant_intersection_missing_variant(spark):
    df = P.conform(preds_df(spark, [("a", 1, 10, 1.0), ("b", 1, 10, 1.0)])).withColumn("family", F.lit("f"))
    assert L1.variant_intersection(df, "f", variants=["a", "b", "c"]).count() == 0
    assert rows(L1.variant_intersection(df, "f", variants=["a", "b"])) == [(1, 10)]


# ------------------------------------------------------------------ O17 / O18 / O21 / O22 / O23


def test_weighted_vote(spark):
    df = P.conform(preds_df(spark, [("a", 1, 10, 1.0), ("b", 1, 11, 1.0), ("c", 1, 11, 1.0)]))
    w = weights(spark, [("a", 0.4), ("b", 0.3), ("c", 0.2)])
    votes = L2.weighted_vote(df, w)
    assert rows(votes, "book_id", "score", "support") == [(10, 400_000, 1), (11, 500_000, 2)]
    assert rows(L2.top1(votes), "user_id", "book_id") == [(1, 11)]


def test_weighted_vote_exact_ties_decided_by_support(spark):
    df = P.conform(preds_df(spark, [("a", 1, 10, 1.0), ("b", 1, 10, 1.0), ("c", 1, 11, 1.0)]))
    w = weights(spark, [("c", 0.3), ("a", 0.1), ("b", 0.2)])
    votes = L2.weighted_vote(df, w)
    assert rows(votes, "book_id", "score") == [(10, 300_000), (11, 300_000)]
    assert rows(L2.top1(votes), "book_id") == [(10,)]


def test_positional_ballots(spark):
    df = P.conform(preds_df(spark, [("a", 1, 10, 3.0), ("a", 1, 11, 2.0), ("a", 1, 12, 1.0)]))
    w = weights(spark, [("a", 0.3)])
    lin = dict(rows(L2.weighted_vote(df, w, k=3, positional="linear"), "book_id", "score"))
    assert lin == {10: 300_000, 11: 200_000, 12: 100_000}
    rec = dict(rows(L2.weighted_vote(df, w, k=3, positional="reciprocal"), "book_id", "score"))
    assert rec == {10: 300_000, 11: 150_000, 12: 100_000}


def test_stable_boost_dominance(spark):
    votes = spark.createDataFrame(
        [(1, 10, 100_000, 1, 2), (1, 11, 900_000, 1, 1)], "user_id long, book_id long, score long, support long, best_priority int"
    )
    stable = spark.createDataFrame([(1, 10)], "user_id long, book_id long")
    boosted = L1.stable_boost(votes, stable, 1 + 1_000_000)
    assert rows(L2.top1(boosted), "book_id") == [(10,)]


def test_arbitrate_ties(spark):
    votes = spark.createDataFrame(
        [(1, 10, 5, 2, 2), (1, 11, 5, 2, 1), (2, 20, 5, 1, 1), (2, 19, 5, 1, 1)],
        "user_id long, book_id long, score long, support long, best_priority int",
    )
    assert rows(L2.top1(votes), "user_id", "book_id") == [(1, 11), (2, 19)]


def test_decision_margin(spark):
    votes = spark.createDataFrame(
        [(1, 10, 500_000, 1, 1), (1, 11, 400_000, 1, 2), (2, 20, 300_000, 1, 1)],
        "user_id long, book_id long, score long, support long, best_priority int",
    )
    assert rows(L2.decision_margin(votes), "user_id", "margin") == [(1, 100_000), (2, 300_000)]


def test_margin_boundary_tie_order_decides(spark):
    df = P.conform(preds_df(spark, [("a", 1, 10, 1.0), ("b", 1, 11, 1.0), ("c", 1, 11, 1.0)]))
    w = weights(spark, [("a", 0.5), ("b", 0.4), ("c", 0.1)])
    votes = L2.weighted_vote(df, w)
    # margin 0.1 with runner-up 0.4: adding 0.1 to it gives equal scores
    assert rows(votes, "book_id", "score") == [(10, 500_000), (11, 500_000)]
    assert rows(L2.top1(votes), "book_id") == [(11,)]  # higher support wins the tie


# ------------------------------------------------------------------ O24 / O25 / O28 / O29 / O30


def test_hit_at_k_denominator(spark):
    truth = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "user_id long, book_id long")
    picks = spark.createDataFrame([(1, 10), (2, 20), (3, 31)], "user_id long, book_id long")
    r = E.hit_at_k(picks, truth).collect()[0]
    assert (r.n_users, r.hits, r.rate) == (4, 2, 0.5)


def test_temporal_holdout_same_day(spark):
    ts = datetime(2020, 1, 1)
    inter = spark.createDataFrame(
        [(5, 10, ts, 1), (5, 11, ts, 2), (5, 12, datetime(2019, 1, 1), 9)],
        "user_id long, book_id long, ts timestamp_ntz, seq long",
    )
    truth, train = E.temporal_holdout(inter)
    assert rows(truth, "user_id", "book_id", "split") == [(5, 11, "validation")]
    assert rows(train, "book_id") == [(12,)]


def test_admission_gate_rejects(spark):
    # backbone b picks the right book 10 for user 1; candidate x would flip
    # user 1 to a wrong book with more weight, so validation hits fall by 1.
    df = P.conform(preds_df(spark, [("b", 1, 10, 1.0), ("x", 1, 11, 1.0), ("y", 1, 10, 1.0)]))
    w = weights(spark, [("b", 0.2), ("x", 0.5), ("y", 0.1)])
    truth = spark.createDataFrame([(1, 10)], "user_id long, book_id long")
    out = rows(E.admission_gate(df, w, ["b"], ["x", "y"], truth), "model", "hits_before", "hits_after", "admitted")
    assert out == [("x", 1, 0, False), ("y", 1, 1, True)]


def test_admission_scenarios_match_naive(spark):
    data = [
        ("b", 1, 10, 1.0), ("b", 2, 20, 1.0), ("c", 1, 11, 1.0), ("c", 3, 30, 1.0),
        ("x", 1, 11, 1.0), ("x", 2, 21, 1.0), ("y", 3, 31, 1.0), ("y", 2, 20, 1.0),
    ]
    df = P.conform(preds_df(spark, data))
    w = weights(spark, [("b", 0.3), ("c", 0.25), ("x", 0.2), ("y", 0.9)])
    truth = spark.createDataFrame([(1, 11), (2, 21), (3, 31)], "user_id long, book_id long")
    got = {r.scenario: r.hits for r in E.admission_scenarios(df, w, ["b", "c"], ["x", "y"], truth, cap=None).collect()}
    for i, extra in enumerate([[], ["x"], ["y"]]):
        naive = E.hit_at_k(L2.top1(L2.weighted_vote(df.filter(F.col("model").isin(["b", "c"] + extra)), w)), truth)
        assert got[i] == naive.collect()[0].hits


def test_pair_lift(spark):
    truth = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4)], "user_id long, book_id long")
    before = spark.createDataFrame([(1, 1), (2, 0), (3, 3), (4, 0)], "user_id long, book_id long")
    after = spark.createDataFrame([(1, 1), (2, 2), (3, 0), (4, 0)], "user_id long, book_id long")
    r = E.pair_lift(before, after, truth).collect()[0]
    assert (r.both_right, r.fixed, r.broken, r.both_wrong) == (1, 1, 1, 1)


def test_submission_check(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    books = spark.createDataFrame([(7,)], "book_id long")
    picks = spark.createDataFrame([(1, 7), (1, 7), (2, 8)], "user_id long, book_id long")
    r = E.submission_check(picks, users, books).collect()[0]
    assert (r.expected, r.delivered, r.missing, r.duplicate_users, r.unknown_books) == (3, 3, 1, 1, 1)


# ------------------------------------------------------------------ O38 / O31 / O36


def test_cold_start_fill(spark):
    ts = datetime(2020, 1, 1)
    train = spark.createDataFrame(
        [(10, 7, ts), (11, 7, ts), (12, 9, ts), (13, 9, ts), (14, 9, ts)], "user_id long, book_id long, ts timestamp_ntz"
    )
    users = spark.createDataFrame(
        [(1, "g"), (10, "g"), (11, "g"), (12, "h"), (13, "h"), (14, "h"), (99, "none")], "user_id long, grp string"
    )
    picks = spark.createDataFrame([(12, 5, 1)], "user_id long, book_id long, score long")
    got = dict(((u, (b, s)) for u, b, s in rows(C.cold_start_fill(picks, users, train), "user_id", "book_id", "source")))
    assert got[1] == (7, "group_top")
    assert got[12] == (5, "pick")
    assert got[99] == (9, "global_top")


def test_graph_propagate_hand_computed(spark):
    ts = datetime(2020, 1, 1)
    # u1: b1; u2: b1, b2.  Readers of b1 in order: u1, u2.
    train = spark.createDataFrame([(1, 1, ts), (2, 1, ts), (2, 2, ts)], "user_id long, book_id long, ts timestamp_ntz")
    got = rows(C.graph_propagate(train, window=2), "user_id", "book_id", "raw_score")
    # u1 -> b1 -> u2 (one place) -> b2 (one place): 2 * 2; u1 has no other book for u2
    assert got == [(1, 2, 4.0)]


def test_heavy_user_and_popular_book_take_part(spark):
    """A user of 200 books and a book of 200 readers both give and get candidates."""
    ts = datetime(2020, 1, 1)
    heavy = [(1, b, ts) for b in range(1, 201)]
    popular = [(u, 500, ts) for u in range(1000, 1200)]
    small = [(u, 1 + u % 200, ts) for u in range(1000, 1200)] + [(1, 500, ts), (2000, 1, ts)] + [(u, 900, ts) for u in range(1000, 1005)]
    train = spark.createDataFrame(heavy + popular + small, "user_id long, book_id long, ts timestamp_ntz")
    for got in (C.graph_propagate(train), C.coborrow_candidates(train)):
        r = rows(got, "user_id", "book_id")
        assert len({u for u, _ in r}) > 190  # users of one popular and one other book
        assert {b for _, b in r} & set(range(1, 201))
        assert (2000, 500) in r and (1, 900) in r
    pairs = C.coborrow_pairs(train, window=5, neighbours=20)
    assert pairs.groupBy("b1").count().agg({"count": "max"}).first()[0] == 20
    assert pairs.filter("b1 = 100").count() >= 10 and pairs.filter("b1 = 500").count() == 20
    seq = C.borrow_sequence(train, "user_id", "_pos")
    assert C.adjacent(seq, "user_id", "_pos", 2, "book_id", "b2").groupBy("user_id", "book_id").count().agg({"count": "max"}).first()[0] == 4
    hot = C.borrow_sequence(train, "book_id", "_pos", hot_rows=50)
    assert rows(hot) == rows(C.borrow_sequence(train, "book_id", "_pos"))


def test_conform_keeps_one_row_for_a_pair_under_two_families(spark):
    df = spark.createDataFrame(
        [("m", "b", 1, 7, 1.0), ("m", "a", 1, 7, 2.0), ("m", "a", 1, 8, 1.5)],
        "model string, family string, user_id long, book_id long, raw_score double",
    )
    for kw in ({"list_bound": 10}, {"hot_rows": 1, "sample_fraction": 1.0}):
        assert rows(P.conform(df, **kw), "family", "book_id", "raw_score", "rnk") == [("a", 7, 2.0, 1), ("a", 8, 1.5, 2)]


def test_calibrate_null_scores_get_the_model_rate(spark):
    data = [("m", u, b, s, i + 1) for u in range(20) for i, (b, s) in enumerate([(u, 10.0), (100 + u, 0.0), (200 + u, None)])]
    df = spark.createDataFrame(data, "model string, user_id long, book_id long, raw_score double, rnk int").withColumn("family", F.col("model"))
    truth = spark.createDataFrame([(u, u) for u in range(20)], "user_id long, book_id long")
    got = {r.book_id: r.cal_score for r in P.calibrate(df, truth).collect()}
    assert got[0] == 21 / 22 and got[100] == 1 / 22 and got[200] == 21 / 62


def test_embedding_variant_of_a_heavy_user(spark):
    """100,000 borrows of unit vectors: the squared norm is far beyond a LONG."""
    ts = datetime(2020, 1, 1)
    train = spark.range(100_000).selectExpr("1L AS user_id", "id % 2 AS book_id").withColumn("ts", F.lit(ts))
    items = spark.createDataFrame([(0, [1.0, 0.0, -0.5]), (1, [0.6, 0.8]), (2, None)], "book_id long, embedding array<float>")
    got = {r.book_id: r.raw_score for r in C.embedding_variant(items, train, 3).collect()}
    p = [1.6, 0.8, -0.5]
    norm = sum(x * x for x in p) ** 0.5
    assert got[0] == pytest.approx((1.6 + 0.25) / norm / 1.25**0.5, rel=1e-6)
    assert got[1] == pytest.approx((0.96 + 0.64) / norm, rel=1e-6)


def test_coborrow_hand_computed(spark):
    ts = datetime(2020, 1, 1)
    train = spark.createDataFrame(
        [(1, 1, ts), (1, 2, ts), (2, 1, ts), (2, 2, ts), (2, 3, ts), (3, 1, ts)],
        "user_id long, book_id long, ts timestamp_ntz",
    )
    got = rows(C.coborrow_candidates(train, 10), "user_id", "book_id", "raw_score")
    # user 3 owns book 1: cooc(1,2) = 2, cooc(1,3) = 1
    assert [(b, s) for u, b, s in got if u == 3] == [(2, 2.0), (3, 1.0)]
    # user 1 owns 1, 2: cooc(1,3) + cooc(2,3) = 2
    assert [(b, s) for u, b, s in got if u == 1] == [(3, 2.0)]


# ------------------------------------------------------------------ skew-safe ranking


def test_rank_within_hot_groups_equals_window(spark):
    from ballot.functions.rank import hot_groups, rank_within

    data = [("a", 1, b, float(b % 7)) for b in range(300)] + [("a", 2, b, 1.0) for b in range(5)]
    df = preds_df(spark, data).withColumnRenamed("raw_score", "s")
    order = [F.col("s").desc(), F.col("book_id").asc()]
    hot = hot_groups(df, ["model", "user_id"], hot_rows=100, fraction=1.0)
    assert rows(hot.select("model", "user_id")) == [("a", 1)]
    split = rank_within(df.repartition(7), ["model", "user_id"], order, "r", hot)
    plain = rank_within(df, ["model", "user_id"], order, "r", None)
    assert rows(split) == rows(plain)
    assert sorted(r.r for r in split.filter("user_id = 1").collect()) == list(range(1, 301))


def test_conform_hot_path_equals_plain(spark):
    data = [("a", 1, b % 250, float(b % 11)) for b in range(400)] + [("b", 1, 3, None), ("b", 2, 4, 2.0)]
    df = preds_df(spark, data)
    plain = P.conform(df, list_bound=1000, hot_rows=10**9)
    hot = P.conform(df, hot_rows=50, sample_fraction=1.0)
    assert rows(hot) == rows(plain)


def test_calibrate_isotonic_is_monotone_per_model(spark):
    data = [("a", u, b, float(b)) for u in range(1, 9) for b in range(4)]
    df = P.conform(preds_df(spark, data))
    truth = spark.createDataFrame([(u, 3 if u % 2 else 0) for u in range(1, 9)], "user_id long, book_id long")
    out = P.calibrate(df, truth, "isotonic").select("raw_score", "cal_score").distinct().collect()
    pts = sorted((r.raw_score, r.cal_score) for r in out)
    assert len(pts) == 4 and all(0.0 <= c <= 1.0 for _, c in pts)
    assert all(a[1] <= b[1] for a, b in zip(pts, pts[1:]))


# ------------------------------------------------------------------ options


def test_string_keys_are_kept(spark):
    df = spark.createDataFrame(
        [("a", "u1", "b10", 0.5), ("a", "u1", "b11", 0.9)], "model string, user_id string, book_id string, raw_score double"
    )
    out = P.conform(df)
    assert dict(out.dtypes)["user_id"] == "string"
    assert rows(out, "book_id", "rnk") == [("b10", 2), ("b11", 1)]


def test_holdout_split_column_for_string_keys(spark):
    ts = datetime(2020, 1, 1)
    inter = spark.createDataFrame(
        [("u1", "b1", ts, 1, "test"), ("u2", "b2", ts, 1, "validation")],
        "user_id string, book_id string, ts timestamp_ntz, seq long, fold string",
    )
    truth, _ = E.temporal_holdout(inter, split_col="fold")
    assert rows(truth, "user_id", "split") == [("u1", "test"), ("u2", "validation")]


def test_pair_lift_details(spark):
    truth = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "user_id long, book_id long")
    before = spark.createDataFrame([(1, 1), (2, 0), (3, 3)], "user_id long, book_id long")
    after = spark.createDataFrame([(1, 1), (2, 2), (3, 0)], "user_id long, book_id long")
    got = rows(E.pair_lift(before, after, truth, details=True), "user_id", "change")
    assert got == [(2, "fixed"), (3, "broken")]


def test_integrate_family_min_score(spark):
    data = [(m, 1, 10, 1.0) for m in ("a", "b")] + [("a", 1, 11, 0.5)]
    df = P.conform(preds_df(spark, data)).withColumn("family", F.lit("f"))
    w = weights(spark, [("a", 0.3), ("b", 0.2)])
    loose = L1.integrate_family(df, "f", w, variants=["a", "b"], k=2, min_support=1)
    assert rows(loose, "book_id") == [(10,), (11,)]
    strict = L1.integrate_family(df, "f", w, variants=["a", "b"], k=2, min_support=1, min_score=400_000)
    assert rows(strict, "book_id") == [(10,)]
