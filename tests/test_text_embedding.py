"""O33: projected tf-idf keeps nearness, and its edge cases."""

import math
import random
from collections import Counter

import pytest

from ballot.operators.text import text_embedding


def _corpus(n=120, seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(40)] for _ in range(n // 2)]
    near = [[w if rng.random() < 0.8 else rng.choice(vocab) for w in b] for b in base]
    return [" ".join(t) for t in base + near]


def _tfidf_cosines(texts):
    docs = [Counter(t.lower().split()) for t in texts]
    rows = Counter(w for d in docs for w in d)
    idf = {w: math.floor(1000 * math.log((len(docs) + 1) / (c + 1)) + 0.5) + 1000 for w, c in rows.items()}
    vecs = [{w: c * idf[w] for w, c in d.items()} for d in docs]
    norm = [math.sqrt(sum(x * x for x in v.values())) for v in vecs]
    dot = lambda a, b: sum(x * b.get(w, 0) for w, x in a.items())
    return {(i, j): dot(vecs[i], vecs[j]) / (norm[i] * norm[j]) for i in range(len(vecs)) for j in range(i)}


@pytest.mark.parametrize("dim", [64, 128])
def test_cosines_follow_tfidf(spark, dim):
    texts = _corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    vec = {r["id"]: list(r["embedding"]) for r in text_embedding(df, "text", dim, id_col="id").collect()}
    exact = _tfidf_cosines(texts)
    errors = [sum(a * b for a, b in zip(vec[i], vec[j])) - c for (i, j), c in exact.items()]
    assert math.sqrt(sum(e * e for e in errors) / len(errors)) < 1.1 / math.sqrt(dim)  # in theory 1 / sqrt(dim) for far pairs
    assert abs(sum(errors) / len(errors)) < 0.02  # no bias
    half = len(texts) // 2
    found = sum(max((j for j in range(len(texts)) if j != i), key=lambda j: sum(a * b for a, b in zip(vec[i], vec[j]))) == i + half for i in range(half))
    assert found >= 0.95 * half


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "A a\tB"), (5, "a A b"), (None, "c")]
    df = spark.createDataFrame(rows, "id long, title string")
    got = {r["id"]: r for r in text_embedding(df, "title", 16, id_col="id").collect()}
    assert len(got) == 6
    for i in (1, 2, 3):
        assert set(got[i]["sums"]) == {0} and got[i]["norm"] == 0.0 and set(got[i]["embedding"]) == {0.0}
    assert got[4]["sums"] == got[5]["sums"] and got[4]["norm"] > 0
    assert abs(sum(x * x for x in got[4]["embedding"]) - 1) < 1e-6
    assert sum(1 for x in got[None]["sums"] if x) == 8
    assert text_embedding(df.limit(0), "title", 16, id_col="id").collect() == []
    with pytest.raises(ValueError):
        text_embedding(df, "title", 20, id_col="id")


def test_partitions_do_not_matter(spark):
    df = spark.createDataFrame(list(enumerate(_corpus(40))), "id long, text string")
    a, b = (sorted((r["id"], tuple(r["sums"])) for r in text_embedding(df.repartition(n), "text", 64, "id").collect()) for n in (1, 7))
    assert a == b
