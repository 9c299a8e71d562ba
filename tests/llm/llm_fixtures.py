"""Fixtures of the training-data operators: awkward rows and small corpora."""

import random

import pytest

SF_SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
# An extra column of another type, and names that operators use themselves.
CLASH = DOC + ", slot string, node string, _row string, _words string, _text long, _gone long, score string, weight string"
VOCAB = [a + b for a in ("ka", "lo", "mi", "nu", "re", "sa", "to", "vi", "za", "pe") for b in ("n", "rt", "lm", "st", "b", "nd", "ck", "sh", "x", "gu")]


def sentence(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def text_of(rng, n):
    words = [rng.choice(VOCAB) for _ in range(n)]
    out, i = [], 0
    while i < n:
        k = rng.randint(6, 14)
        out.append(" ".join(words[i : i + k]).capitalize() + ".")
        i += k
    return "".join(x + rng.choice([" ", "\n"]) for x in out).strip()


def awkward_rows():
    """Nulls in every column, empty and blank texts, one word, a very long
    text, repeated rows, one id with two texts."""
    rng = random.Random(5)
    long = text_of(rng, 30_000)
    copy = text_of(rng, 120)
    rows = [
        (None, copy, None, None, None),
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \t\r\n\x0b\x0c ", "en", None, 7),
        (4, "word", "en", "b", 4),
        (5, long, "en", "b", len(long)),
        (6, copy, "en", "b", None),
        (6, copy, "en", "b", None),
        (7, copy, None, "a", 1),
        (8, copy + " another end", "en", "é", 1),
        (9, text_of(rng, 80), "en", "é", 1),
        (9, text_of(rng, 90), "en", "é", 1),
        (10, "x" * 200_000, "en", "a", 1),
        (11, "1" * 100_000 + " " + "a@" * 3_000, "en", "a", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOC)


@pytest.fixture(scope="session")
def clashing(spark):
    rows = [(*r, "s", "n", "r", "w", 1, 2, "q", "z") for r in awkward_rows()]
    return spark.createDataFrame(rows, CLASH)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def near_rows():
    """Base texts, copies with a few words changed, chains, and one large group."""
    rng = random.Random(11)
    rows, n = [], 0
    for _ in range(40):
        words = [rng.choice(VOCAB) for _ in range(rng.randint(5, 150))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            rows.append((n, " ".join(words), "en", "a", 1))
            n += 1
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(VOCAB)
    big = [rng.choice(VOCAB) for _ in range(200)]
    for _ in range(60):
        words = list(big)
        words[rng.randrange(len(words))] = rng.choice(VOCAB)
        rows.append((n, " ".join(words).upper(), "en", "a", 1))
        n += 1
    rng.shuffle(rows)
    return rows
