"""Random small inputs: Spark operators against a plain-Python brute force
"""

import math

from conftest import preds_df
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ballot.operators import layer2 as L2
from ballot.operators import prepare as P
from ballot.operators import weights as W
from ballot.schema import BACKBONE

MODELS = ["a", "b", "c", "d"]
score = st.one_of(st.none(), st.sampled_from([float("nan"), float("inf")]), st.integers(0, 4).map(float))
row = st.tuples(st.sampled_from(MODELS), st.integers(1, 4), st.integers(1, 6), score)


def brute_conform(rows):
    best = {}
    for m, u, b, s in rows:
        s = None if s is None or math.isnan(s) or math.isinf(s) else s
        key = (m, u, b)
        if key not in best or (s is not None and (best[key] is None or s > best[key])):
            best[key] = s
    lists = {}
    for (m, u, b), s in best.items():
        lists.setdefault((m, u), []).append((b, s))
    out = {}
    for (m, u), items in lists.items():
        items.sort(key=lambda t: (t[1] is None, -(t[1] or 0.0), t[0]))
        for r, (b, s) in enumerate(items, start=1):
            out[(m, u, b)] = (s, r)
    return out


def brute_top1(conformed, weights, k):
    votes = {}
    for (m, u, b), (_s, r) in conformed.items():
        if r <= k:
            w, prio = weights[m]
            sc, sup, bp = votes.get((u, b), (0, 0, 10**9))
            votes[(u, b)] = (sc + w, sup + 1, min(bp, prio))
    best = {}
    for (u, b), (sc, sup, bp) in votes.items():
        key = (-sc, -sup, bp, b)
        if u not in best or key < best[u][0]:
            best[u] = (key, b)
    return {u: b for u, (_k, b) in best.items()}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(row, min_size=0, max_size=40), ws=st.permutations([100, 200, 300, 300]), k=st.integers(1, 3))
def test_conform_and_vote_match_bruteforce(spark, rows, ws, k):
    df = preds_df(spark, rows)
    conf = P.conform(df, list_bound=100)
    got = {(r.model, r.user_id, r.book_id): (r.raw_score, r.rnk) for r in conf.collect()}
    exp = brute_conform(rows)
    assert got == exp

    weights = {m: (w * 1000, i + 1) for i, (m, w) in enumerate(zip(MODELS, ws))}
    wdf = W.weights_frame(spark, [(m, w, p, BACKBONE) for m, (w, p) in weights.items()])
    picks = L2.top1(L2.weighted_vote(conf, wdf, k=k, validate=False))
    assert {r.user_id: r.book_id for r in picks.collect()} == brute_top1(exp, weights, k)
