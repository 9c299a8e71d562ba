"""O08 with uncertainty: counts, bounds and degenerate inputs."""

import hashlib
import math

import pytest

from ballot.operators.weights import bootstrap_weights, poisson_limits, replicate_counts


def _count(seed, rep, user):
    digest = hashlib.md5(f"{seed}:{rep // 8}:{user}".encode()).hexdigest()
    v = int(digest[4 * (rep % 8) : 4 * (rep % 8) + 4], 16)
    limits = [math.floor(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(j + 1))) for j in range(8)]
    return sum(v >= x for x in limits)


def _truth(spark, n):
    return spark.createDataFrame([(u, 1) for u in range(n)], "user_id long, book_id long")


def test_counts_are_poisson(spark):
    df = spark.range(4000).withColumnRenamed("id", "user_id").select("user_id", replicate_counts(16, 7).alias("c"))
    got = {r["user_id"]: list(r["c"]) for r in df.collect()}
    assert all(got[u] == [_count(7, r, u) for r in range(16)] for u in range(0, 4000, 37))
    flat = [x for c in got.values() for x in c]
    mean = sum(flat) / len(flat)
    assert abs(mean - 1) < 0.02 and abs(sum((x - mean) ** 2 for x in flat) / len(flat) - 1) < 0.04
    assert poisson_limits()[0] == 24109


def test_lower_bound(spark):
    rows = [("all", u, 1 if u % 2 else 2, 1.0) for u in range(200)]  # half of all users
    rows += [("few", u, 1, 1.0) for u in range(3)] + [("none", u, 9, 1.0) for u in range(200)]
    preds = spark.createDataFrame(
        [(m, m, u, b, s, 1) for m, u, b, s in rows], "model string, family string, user_id long, book_id long, raw_score double, rnk int"
    )
    got = {r["model"]: r for r in bootstrap_weights(preds, _truth(spark, 200), aux=["few"], replicates=16, drop=1).collect()}
    for m, hit in (("all", range(1, 200, 2)), ("few", range(3)), ("none", ())):
        want = sorted(sum(_count(42, r, u) for u in hit) * 10**6 // sum(_count(42, r, u) for u in range(200)) for r in range(16))
        assert got[m]["weight"] == want[1]
        assert got[m]["plain"] == len(list(hit)) * 10**6 // 200
    assert got["all"]["weight"] < got["all"]["plain"]
    assert [got[m]["priority"] for m in ("all", "few", "none")] == [1, 2, 3]
    assert got["few"]["role"] == "aux"


def test_degenerate(spark):
    preds = spark.createDataFrame([("a", "a", 1, 1, 1.0, 1)], "model string, family string, user_id long, book_id long, raw_score double, rnk int")
    r = bootstrap_weights(preds, _truth(spark, 0)).collect()[0]
    assert (r["hits"], r["n_users"], r["plain"], r["weight"]) == (0, 0, 0, 0)
    assert bootstrap_weights(preds.limit(0), _truth(spark, 5)).collect() == []
    with pytest.raises(ValueError):
        bootstrap_weights(preds, _truth(spark, 5), replicates=2, drop=2)
