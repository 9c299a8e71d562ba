"""O08 model_weights, O09 cap_weights, O12 attach_weights, plus weight tables.

A weights frame has one row per model: ``model, weight (LONG micro-votes),
priority (INT, 1 = strongest, unique), role ('backbone' | 'aux')``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ballot.functions import bounded_broadcast, idiv, scalar_count
from ballot.schema import AUX, BACKBONE, BOOK, MICRO, MODEL, PRIORITY, RNK, ROLE, USER, WEIGHT, WEIGHTS


def weights_frame(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """Build a weights frame from ``(model, weight_micro, priority, role)`` tuples."""
    rows = list(rows)
    prios = [r[2] for r in rows]
    if len(set(prios)) != len(prios):
        raise ValueError("priorities must be unique")
    return spark.createDataFrame(rows, WEIGHTS)


def model_weights(df: DataFrame, truth: DataFrame, k: int = 1, aux: Iterable[str] | Mapping = ()) -> DataFrame:
    """Weight = hits@k / number of validation users, in micro-votes.

    ``truth`` holds the validation users.  A user a model skipped counts as a
    miss.  ``priority`` orders weight desc, then model asc.  Models named in
    ``aux`` (or whose family is) get role 'aux', the rest 'backbone'.
    Output: model, hits, n_users, weight, priority, role.
    """
    aux = list(aux)
    models = df.select(MODEL, "family").distinct()
    t = truth.select(USER, F.col(BOOK).alias("_truth"))
    hits = (
        df.filter(F.col(RNK) <= k)
        .join(t, USER, "inner")
        .filter(F.col(BOOK) == F.col("_truth"))
        .groupBy(MODEL)
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    n_users = scalar_count(truth)
    out = (
        models.join(hits, MODEL, "left")
        .select(
            MODEL,
            "family",
            F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
            n_users.cast("long").alias("n_users"),
        )
        .withColumn(WEIGHT, F.coalesce(idiv(F.col("hits") * MICRO, F.col("n_users")), F.lit(0)).cast("long"))
    )
    # One row per model: a global window over a frame of model-count rows.
    w = Window.orderBy(F.col(WEIGHT).desc(), F.col(MODEL).asc())
    role = F.when(F.col(MODEL).isin(aux) | F.col("family").isin(aux), F.lit(AUX)).otherwise(F.lit(BACKBONE))
    return out.select(
        MODEL, "hits", "n_users", WEIGHT, F.row_number().over(w).cast("int").alias(PRIORITY), role.alias(ROLE)
    )


def poisson_limits(bits: int = 16) -> list[int]:
    """Limits that a uniform number of ``bits`` bits reaches as often as a
    Poisson(1) count is larger than 0, 1, 2, ...: 2^bits times its distribution."""
    limits, term, total = [], math.exp(-1), 0.0
    for j in range(bits):
        total += term
        limits.append(math.floor(total * 2**bits))
        term /= j + 1
        if limits[-1] >= 2**bits - 1:
            break
    return limits


def replicate_counts(replicates: int, seed: int) -> Column:
    """How often a user is drawn in each replicate: one Poisson(1) count for every
    four hex digits of the md5 of seed, block and user."""
    limits = poisson_limits()
    counts = []
    for r in range(replicates):
        digits = f"substring(md5(concat('{int(seed)}:{r // 8}:', cast({USER} AS STRING))), {4 * (r % 8) + 1}, 4)"
        counts.append(f"cast(conv({digits}, 16, 10) AS INT)")
    at_least = " + ".join(f"cast(v >= {x} AS INT)" for x in limits)
    return F.expr(f"transform(array({', '.join(counts)}), v -> {at_least})")


def bootstrap_weights(
    df: DataFrame,
    truth: DataFrame,
    k: int = 1,
    aux: Iterable[str] | Mapping = (),
    replicates: int = 32,
    drop: int = 2,
    seed: int = 42,
) -> DataFrame:
    """``model_weights`` with a lower bound in place of the plain rate.

    Validation users are drawn again ``replicates`` times by hashed Poisson
    counts; a replicate's weight is its hits * 10^6 div its users (0 without
    users).  ``weight`` is the smallest of them after the ``drop`` smallest, so a
    model that few users test weighs less than one as good on many.  All
    replicates are sums of one aggregate over one read of the lists.
    Output: model, hits, n_users, plain, weight, priority, role.
    """
    if not 0 <= drop < replicates:
        raise ValueError("drop must be below replicates")
    aux = list(aux)
    each = range(replicates)
    drawn = truth.select(USER).withColumn("_c", replicate_counts(replicates, seed))
    sums = [F.coalesce(F.sum(F.get("_c", F.lit(r))), F.lit(0)).cast("long") for r in each]
    users = drawn.agg(F.array(F.count(F.lit(1)).cast("long"), *sums).alias("_n")).scalar()
    t = truth.select(USER, F.col(BOOK).alias("_truth"))
    hit = (F.col(RNK) <= k) & (F.col(BOOK) == F.col("_truth"))
    rows = df.select(MODEL, "family", USER, BOOK, RNK).join(t, USER, "left").withColumn("_hit", F.coalesce(hit, F.lit(False)))
    rows = rows.withColumn("_c", F.when(F.col("_hit"), replicate_counts(replicates, seed)))
    hits = rows.groupBy(MODEL, "family").agg(F.count_if("_hit").cast("long").alias("hits"), F.array(*sums).alias("_h"))
    hits = hits.withColumn("_n", users)
    rate = lambda h, n: F.coalesce(idiv(h * MICRO, F.nullif(n, F.lit(0).cast("long"))), F.lit(0)).cast("long")
    weights = F.array(*[rate(F.get("_h", F.lit(r)), F.get("_n", F.lit(r + 1))) for r in each])
    n_users = F.get("_n", F.lit(0))
    out = hits.select(
        MODEL,
        "family",
        "hits",
        n_users.alias("n_users"),
        rate(F.col("hits"), n_users).alias("plain"),
        F.get(F.sort_array(weights), F.lit(drop)).alias(WEIGHT),
    )
    # One row per model: a global window over a frame of model-count rows.
    w = Window.orderBy(F.col(WEIGHT).desc(), F.col("plain").desc(), F.col(MODEL).asc())
    role = F.when(F.col(MODEL).isin(aux) | F.col("family").isin(aux), F.lit(AUX)).otherwise(F.lit(BACKBONE))
    priority = F.row_number().over(w).cast("int")
    return out.select(MODEL, "hits", "n_users", "plain", WEIGHT, priority.alias(PRIORITY), role.alias(ROLE))


def cap_weights(weights: DataFrame, cap: int, total_cap: int | None = None) -> DataFrame:
    """Aux models get ``least(weight, cap)``; backbone weights are unchanged.

    With ``total_cap``, if the capped aux weights sum above it, every aux weight
    is scaled to ``weight * total_cap div sum``.
    """
    is_aux = F.col(ROLE) == F.lit(AUX)
    capped = weights.withColumn(WEIGHT, F.when(is_aux, F.least(F.col(WEIGHT), F.lit(cap))).otherwise(F.col(WEIGHT)))
    if total_cap is None:
        return capped
    aux_sum = capped.filter(is_aux).select(F.coalesce(F.sum(WEIGHT), F.lit(0)).cast("long")).scalar()
    scaled = F.when(
        is_aux & (aux_sum > F.lit(total_cap)), idiv(F.col(WEIGHT) * F.lit(total_cap), aux_sum)
    ).otherwise(F.col(WEIGHT))
    return capped.withColumn(WEIGHT, scaled.cast("long"))


def attach_weights(df: DataFrame, weights: DataFrame, validate: bool | str = True) -> DataFrame:
    """Join predictions to their model's weight, priority and role.

    ``validate``: ``True`` (or ``"eager"``) raises ``ValueError`` for a model
    without a weight, at the cost of one extra pass over the distinct model
    names; ``"lazy"`` checks inside the same plan (the job fails with the model
    name, no extra pass); ``False`` skips the check (weights known to cover
    every model, e.g. computed from the same predictions).  The weights side
    has one row per model and is broadcast after a size check.
    """
    w = bounded_broadcast(weights.select(MODEL, WEIGHT, PRIORITY, ROLE), cache=True)
    if validate is True or validate == "eager":
        missing = df.select(MODEL).distinct().join(w, MODEL, "left_anti").limit(5).collect()
        if missing:
            raise ValueError(f"models without a weight: {sorted(r[0] for r in missing)}")
        return df.join(w, MODEL, "inner")
    if validate == "lazy":
        j = df.join(w, MODEL, "left")
        err = F.raise_error(F.concat(F.lit("model without a weight: "), F.col(MODEL)))
        return j.withColumn(WEIGHT, F.when(F.col(WEIGHT).isNull(), err).otherwise(F.col(WEIGHT)).cast("long"))
    return df.join(w, MODEL, "inner")
