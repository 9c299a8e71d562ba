
import pytest
from conftest import SF_SMALL, rows
from pyspark.sql import functions as F

from ballot.operators import evaluate as E
from ballot.operators import layer1 as L1
from ballot.operators import layer2 as L2
from ballot.operators import prepare as P
from ballot.operators import weights as W
from ballot.plans.registry import Ctx
from ballot.sources.fixture import MODEL_IDS, V5


@pytest.fixture(scope="module")
def ctx(spark):
    c = Ctx(spark, SF_SMALL)
    c.preds = c.preds.cache()
    return c


def picks_of(df, w):
    return rows(L2.top1(L2.weighted_vote(df, w)), "user_id", "book_id")


def test_fixture_expected_values(ctx):
    assert ctx.truth.count() == 150
    assert ctx.raw.count() == 24_000
    assert ctx.preds.count() == 23_448
    ids = F.create_map(*[x for m, i in MODEL_IDS.items() for x in (F.lit(m), F.lit(i))])
    chk = ctx.preds.select(F.sum(31 * F.col("user_id") + 17 * F.col("book_id") + 7 * F.col("rnk") + ids[F.col("model")]))
    assert chk.collect()[0][0] == 94_718_163


def test_monotone_score_transform_keeps_picks(ctx):
    base = picks_of(ctx.preds, ctx.fw)
    raw2 = ctx.raw.withColumn("raw_score", F.exp(F.col("raw_score") / 1000.0) * 3 + 7)
    assert picks_of(P.conform(raw2), ctx.fw) == base


def test_weight_scaling_keeps_picks(ctx):
    base = picks_of(ctx.preds, ctx.fw)
    w3 = ctx.fw.withColumn("weight", F.col("weight") * 3)
    assert picks_of(ctx.preds, w3) == base


def test_duplicated_input_changes_nothing(ctx):
    assert rows(P.conform(ctx.raw.unionByName(ctx.raw))) == rows(P.conform(ctx.raw))


def test_shuffle_partitions_do_not_change_rows(spark, ctx):
    outs = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 8, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            shuffled = ctx.raw.orderBy(F.rand(n))
            outs.append(rows(L2.top1(L2.weighted_vote(P.conform(shuffled), ctx.fw))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert outs[0] == outs[1] == outs[2]


def test_intersection_equals_intersect_chain(ctx):
    sub = ["v5_01", "v5_02", "v5_03"]
    got = rows(L1.variant_intersection(ctx.preds, "v5", k=10, variants=sub))
    top = ctx.preds.filter(F.col("rnk") <= 10)
    chain = None
    for m in sub:
        part = top.filter(F.col("model") == m).select("user_id", "book_id")
        chain = part if chain is None else chain.intersect(part)
    assert got == rows(chain)


def test_larger_min_support_gives_subset(ctx):
    a = set(rows(L1.support_filter(ctx.preds, "v5", 6), "user_id", "book_id"))
    b = set(rows(L1.support_filter(ctx.preds, "v5", 8), "user_id", "book_id"))
    assert b <= a and len(b) < len(a)


def test_every_user_once_after_cascade(spark, ctx):
    votes = L2.weighted_vote(ctx.preds, ctx.fw)
    from ballot.operators.candidates import cold_start_sources

    picks = L2.cascade([("consensus", L2.top1(L2.consensus_filter(votes, 4)))] + cold_start_sources(ctx.users, ctx.train))
    chk = E.submission_check(picks, ctx.users, ctx.books).collect()[0]
    assert chk.missing == 0 and chk.duplicate_users == 0 and chk.null_keys == 0


def test_margin_bounds_added_weight(ctx):
    """margin > W: adding aux ballots of total weight <= W changes no pick."""
    bb = ctx.preds.filter(F.col("model").isin(["hybrid"] + V5))
    votes = L2.weighted_vote(bb, ctx.fw)
    margins = {r.user_id: (r.book_id, r.margin) for r in L2.decision_margin(votes).collect()}
    W_aux = 150_000
    aux_w = ctx.fw.withColumn("weight", F.when(F.col("model") == "automl", W_aux).otherwise(F.col("weight")))
    both = L2.top1(L2.weighted_vote(ctx.preds.filter(F.col("model").isin(["hybrid", "automl"] + V5)), aux_w))
    after = {r.user_id: r.book_id for r in both.collect()}
    safe = [u for u, (_, m) in margins.items() if m > W_aux]
    assert safe, "fixture should have safe users"
    assert all(after[u] == margins[u][0] for u in safe)


def test_admitted_set_never_lowers_validation_hits(ctx):
    gate = E.admission_gate(ctx.preds, ctx.fw, ["hybrid"], ["dspos2", "v5_01", "automl"], ctx.val).collect()
    hits = None
    for r in gate:
        if hits is not None and r.model:
            assert r.hits_before == hits
        if r.admitted:
            assert r.hits_after >= r.hits_before
            hits = r.hits_after
        else:
            hits = r.hits_before


def test_model_weights_rank_by_hits(ctx):
    w = W.model_weights(ctx.preds, ctx.val).collect()
    prios = sorted(w, key=lambda r: r.priority)
    assert [r.weight for r in prios] == sorted((r.weight for r in w), reverse=True)
