"""Isotonic calibration in one plan, and its use in Layer 1."""

import random
from fractions import Fraction

import pytest
from conftest import preds_df
from pyspark.sql import functions as F

from ballot.operators import isotonic, layer1, prepare
from ballot.operators.weights import weights_frame


def brute(points):
    """max over starts of min over ends of the rate between, for (x, n, hits) by x."""
    out = {}
    for i, (x, _, _) in enumerate(points):
        best = None
        for a in range(i + 1):
            least = min(Fraction(sum(p[2] for p in points[a : b + 1]), sum(p[1] for p in points[a : b + 1])) for b in range(i, len(points)))
            best = least if best is None else max(best, least)
        out[x] = best
    return out


def test_pool_equals_max_min():
    rng = random.Random(1)
    for _ in range(200):
        points = [(float(i), n := rng.randint(1, 9), rng.randint(0, n)) for i in range(rng.randint(1, 14))]
        got = {}
        for lo, hi, n, hits in isotonic.pool((x, x, n, h) for x, n, h in points):
            got |= {x: Fraction(hits, n) for x, _, _ in points if lo <= x <= hi}
        assert got == brute(points)


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_blocks_of_many_models(spark, ranges):
    rng = random.Random(2)
    rows = [(m, round(rng.gauss(0, 1), 1) if m != "none" else None, int(rng.random() < 0.3)) for m in ("a", "b", "none") for _ in range(400)]
    rows += [("one", 0.5, 1)] * 500
    df = spark.createDataFrame(rows, "model string, x double, hit int")
    blocks = isotonic.isotonic_blocks(df, ranges).collect()
    assert {r.model for r in blocks} == {"a", "b", "one"}
    for m in ("a", "b", "one"):
        points = {}
        for _, x, h in (r for r in rows if r[0] == m):
            n, hits = points.get(x, (0, 0))
            points[x] = (n + 1, hits + h)
        want = brute([(x, *points[x]) for x in sorted(points)])
        own = [r for r in blocks if r.model == m]
        assert {x: Fraction(r.hits, r.n) for r in own for x in points if r.lo <= x <= r.hi} == want
        assert sum(r.n for r in own) == sum(n for n, _ in points.values())


def test_scores_between_blocks_and_without_any(spark):
    blocks = spark.createDataFrame([("a", 0.2, 0.4, 10, 1), ("a", 0.6, 0.8, 10, 5)], "model string, lo double, hi double, n long, hits long")
    df = spark.createDataFrame([("a", x) for x in (0.1, 0.3, 0.5, 0.6, 0.9, None)] + [("b", 0.3)], "model string, x double")
    out = isotonic.isotonic_scores(df, blocks, "x", "block").withColumn("p", isotonic.rate("block")).collect()
    assert {(r.model, r.x): r.p for r in out} == {("a", 0.1): 0.1, ("a", 0.3): 0.1, ("a", 0.5): 0.1, ("a", 0.6): 0.5, ("a", 0.9): 0.5, ("a", None): None, ("b", 0.3): None}


def test_calibration_of_no_rows(spark):
    df = prepare.conform(preds_df(spark, [("a", 1, 1, 0.5)]))
    none = spark.createDataFrame([], "user_id long, book_id long")
    assert [r.cal_score for r in prepare.calibrate(df, none, "isotonic").collect()] == [None]


def test_layer1_orders_ties_by_calibrated_scores(spark):
    """Books 7 and 8 get the same fused score; the validation users bear out the second place of b."""
    rows = [("a", u, 7, 2.0) for u in range(1, 5)] + [("a", u, 8, 1.0) for u in range(1, 5)]
    rows += [("b", u, 8, 2.0) for u in range(1, 5)] + [("b", u, 7, 1.0) for u in range(1, 5)]
    df = prepare.conform(preds_df(spark, rows)).withColumn("family", F.lit("f"))
    w = weights_frame(spark, [("a", 100, 1, "backbone"), ("b", 100, 2, "backbone")])
    top = lambda truth: {r.user_id: r.book_id for r in layer1.integrate_family(df, "f", w, ["a", "b"], k=2, min_support=1, truth=truth).filter("rnk = 1").collect()}
    assert set(top(None).values()) == {7}
    truth = spark.createDataFrame([(u, 8) for u in range(1, 3)], "user_id long, book_id long")
    assert set(top(truth).values()) == {8}
