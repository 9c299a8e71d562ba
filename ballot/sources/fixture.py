"""Planted prediction lists built around the real truth (FIXTURES.md §2).

Sixteen models with planted accuracy, pure integer arithmetic, so Spark and
DuckDB produce the same rows.  The lists are generated per truth user with
``explode`` (no join), after hashing truth users across partitions, so the
160-fold expansion is spread over every task.  For files a model (``parts``) the
users of each model are dealt by range, so a task holds few models and writes
few files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballot.functions import scalar_count
from ballot.schema import AUX, BACKBONE, BOOK, FAMILY, MODEL, RAW, RNK, USER, WEIGHTS
from ballot.sources.tables import table, tpch_interactions

# Fixed values of the planted fixture (FIXTURES.md §2.2):
# (id, model, family, accuracy threshold out of 10007, probe weight)
FIXTURE_MODELS = [
    (1, "v5_01", "v5", 2600, 100),
    (2, "v5_02", "v5", 2700, 100),
    (3, "v5_03", "v5", 2500, 100),
    (4, "v5_04", "v5", 2800, 100),
    (5, "v5_05", "v5", 2650, 100),
    (6, "v5_06", "v5", 2400, 100),
    (7, "v5_07", "v5", 2750, 100),
    (8, "v5_08", "v5", 2550, 100),
    (9, "v5_09", "v5", 2300, 100),
    (10, "v5_10", "v5", 2450, 100),
    (11, "hybrid", "hybrid", 3000, 380),
    (12, "dspos2", "dspos2", 2400, 360),
    (13, "m133", "m133", 1900, 340),
    (14, "f1", "f1", 1500, 320),
    (15, "v2", "v2", 1200, 300),
    (16, "automl", "automl", 800, 280),
]
LIST_DEPTH = 10
# Families whose models enter Layer 2 with a small, capped weight.
FIXTURE_AUX = ("dspos2", "m133", "f1", "v2", "automl")
V5 = [m[1] for m in FIXTURE_MODELS if m[2] == "v5"]
MODEL_IDS = {m[1]: m[0] for m in FIXTURE_MODELS}


def fixture_weights(spark: SparkSession) -> DataFrame:
    """Probe weights in micro-votes (probe weight x 1000); priority = model id."""
    rows = [
        (name, w * 1000, mid, AUX if fam in FIXTURE_AUX else BACKBONE) for mid, name, fam, _acc, w in FIXTURE_MODELS
    ]
    return spark.createDataFrame(rows, WEIGHTS)


def fixture_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last borrow per customer (O25 on the order/line-item interactions)."""
    from ballot.operators.evaluate import temporal_holdout

    truth, _train = temporal_holdout(tpch_interactions(spark, sf_dir))
    return truth


def _planted_rows(truth: DataFrame, n_books: Column, parts: int | None = None) -> DataFrame:
    spec = F.array(
        *[
            F.struct(
                F.lit(mid).cast("long").alias("m"),
                F.lit(name).alias(MODEL),
                F.lit(fam).alias(FAMILY),
                F.lit(acc).cast("long").alias("acc"),
            )
            for mid, name, fam, acc, _w in FIXTURE_MODELS
        ]
    )
    # An explicit partition count on (user, truth book): AQE would coalesce the
    # small truth frame to one partition and run the whole 160-fold expansion
    # in one task; a by-number repartition on keys that differ from the
    # upstream window's is neither removed nor coalesced.
    n_parts = int(truth.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = truth.select(F.col(USER).cast("long").alias("u"), F.col(BOOK).cast("long").alias("tb"))
    if parts is None:
        base = base.repartition(n_parts, "u", "tb")
    per_model = base.select("u", "tb", F.explode(spec).alias("s")).select("u", "tb", "s.*")
    if parts is not None:
        per_model = per_model.repartitionByRange(parts, "m", "u")
    rows = per_model.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(LIST_DEPTH).cast("long"))).alias("r"))
    u, m, r, acc = F.col("u"), F.col("m"), F.col("r"), F.col("acc")
    h = ((u + 17) * (m * 31 + 7) * 7919 + (u + m) * (u + m) * 104729) % 10007
    g = F.when((F.col(FAMILY) == "v5") & (r <= 5) & ((u + m) % 4 > 0), F.lit(0).cast("long")).otherwise(m * m * 7)
    filler = (u * 131 + r * 1299709 + g * 31 + r * r * u) % n_books
    book = (
        F.when((h < acc) & (r == 1), F.col("tb"))
        .when((h >= acc) & (h < acc + 2500) & (r == h % 9 + 2), F.col("tb"))
        .otherwise(filler)
    )
    raw = (m * 1000 - ((m % 7) + 1) * r).cast("double")
    return rows.select(
        MODEL,
        FAMILY,
        F.col("u").alias(USER),
        book.cast("long").alias(BOOK),
        raw.alias(RAW),
        F.lit(None).cast("int").alias(RNK),
    )


def planted_predictions(spark: SparkSession, sf_dir: str, truth: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Raw planted lists (before conform): model, family, user_id, book_id,
    raw_score, rnk (NULL: order comes from the score).  ``parts``: partitions by
    range of model and user; ``truth`` is then read twice and should be a stage."""
    truth = truth if truth is not None else fixture_truth(spark, sf_dir)
    n_books = scalar_count(table(spark, sf_dir, "part").select("p_partkey")).cast("long")
    return _planted_rows(truth, n_books, parts)
