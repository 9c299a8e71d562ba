"""Canonical schemas, column names and fixed units.

Weights and vote totals are integers in micro-votes: one vote of weight 1.0 is
1,000,000.  Double sums depend on the order partitions are combined in, and a
Top-1 tie could then flip between runs; integer sums cannot.
"""

from __future__ import annotations

from pyspark.sql import types as T

MICRO = 1_000_000

USER = "user_id"
BOOK = "book_id"
MODEL = "model"
FAMILY = "family"
RAW = "raw_score"
RNK = "rnk"
WEIGHT = "weight"
PRIORITY = "priority"
ROLE = "role"

BACKBONE = "backbone"
AUX = "aux"

PREDICTIONS = T.StructType(
    [
        T.StructField(MODEL, T.StringType(), False),
        T.StructField(FAMILY, T.StringType(), False),
        T.StructField(USER, T.LongType(), True),
        T.StructField(BOOK, T.LongType(), True),
        T.StructField(RAW, T.DoubleType(), True),
        T.StructField(RNK, T.IntegerType(), True),
    ]
)

WEIGHTS = T.StructType(
    [
        T.StructField(MODEL, T.StringType(), False),
        T.StructField(WEIGHT, T.LongType(), False),
        T.StructField(PRIORITY, T.IntegerType(), False),
        T.StructField(ROLE, T.StringType(), False),
    ]
)

TRUTH = T.StructType(
    [
        T.StructField(USER, T.LongType(), False),
        T.StructField(BOOK, T.LongType(), False),
    ]
)

INTERACTIONS = T.StructType(
    [
        T.StructField(USER, T.LongType(), False),
        T.StructField(BOOK, T.LongType(), False),
        T.StructField("ts", T.TimestampNTZType(), True),
        T.StructField("seq", T.LongType(), False),
    ]
)

VOTES = T.StructType(
    [
        T.StructField(USER, T.LongType(), True),
        T.StructField(BOOK, T.LongType(), True),
        T.StructField("score", T.LongType(), True),
        T.StructField("support", T.LongType(), False),
        T.StructField("best_priority", T.IntegerType(), True),
    ]
)

PICKS = T.StructType(
    [
        T.StructField(USER, T.LongType(), True),
        T.StructField(BOOK, T.LongType(), True),
        T.StructField("score", T.LongType(), True),
        T.StructField("source", T.StringType(), False),
    ]
)

# Prediction-file layout on disk (O01): one CSV per model, with a header.
# Either a score or a rank column must be present.
PREDICTION_FILE = T.StructType(
    [
        T.StructField(USER, T.LongType(), True),
        T.StructField(BOOK, T.LongType(), True),
        T.StructField(RAW, T.DoubleType(), True),
        T.StructField(RNK, T.IntegerType(), True),
    ]
)

SUBMISSION = T.StructType(
    [
        T.StructField(USER, T.LongType(), True),
        T.StructField(BOOK, T.LongType(), True),
    ]
)


def to_micro(fraction: float) -> int:
    """Convert a weight given as a fraction to micro-votes, once, half up."""
    import math

    return int(math.floor(fraction * MICRO + 0.5))
