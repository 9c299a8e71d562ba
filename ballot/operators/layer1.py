"""Layer 1: O10 support_filter, O15 variant_intersection, O18 stable_boost,
O19 integrate_family, O20 topk_fusion.

A family's variants are counted with one aggregate on (user, book), never with
a chain of N - 1 INTERSECT joins.  After ``conform`` every (model, user, book)
is unique, so ``count`` equals ``count(DISTINCT model)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballot.functions import idiv, partitions_for, scalar_count
from ballot.operators.layer2 import BALLOTS_EACH, arbitrate, ballot_value, weighted_vote
from ballot.operators.isotonic import isotonic_scores
from ballot.operators.prepare import fitted_blocks, standardize
from ballot.operators.weights import attach_weights
from ballot.schema import BOOK, FAMILY, MICRO, MODEL, RAW, RNK, USER, WEIGHT


def _family_rows(df: DataFrame, family: str, k: int, variants: Sequence[str] | None) -> DataFrame:
    fam = df.filter((F.col(FAMILY) == family) & (F.col(RNK) <= k))
    if variants is not None:
        fam = fam.filter(F.col(MODEL).isin(list(variants)))
    return fam


def _n_variants(df: DataFrame, family: str, variants: Sequence[str] | None) -> Column:
    if variants is not None:
        return F.lit(len(set(variants))).cast("long")
    return scalar_count(df.filter(F.col(FAMILY) == family).select(MODEL).distinct()).cast("long")


def support_filter(
    df: DataFrame, family: str, min_support: int = 7, k: int = 10, variants: Sequence[str] | None = None
) -> DataFrame:
    """Pairs listed in the Top-k of at least ``min_support`` variants.

    Output: user_id, book_id, support.
    """
    fam = _family_rows(df, family, k, variants)
    return (
        fam.groupBy(USER, BOOK)
        .agg(F.count(F.lit(1)).cast("long").alias("support"))
        .filter(F.col("support") >= min_support)
    )


def variant_intersection(df: DataFrame, family: str, k: int = 10, variants: Sequence[str] | None = None) -> DataFrame:
    """Books every registered variant of the family puts in a user's Top-k.

    N is the number of variants *registered* (``variants``, or the distinct
    models of the family), so a user missing from one variant has an empty
    stable set.  Output: user_id, book_id.
    """
    fam = _family_rows(df, family, k, variants)
    n = _n_variants(df, family, variants)
    return fam.groupBy(USER, BOOK).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == n).select(USER, BOOK)


def stable_boost(votes: DataFrame, stable: DataFrame, boost: int | Column) -> DataFrame:
    """Add ``boost`` to the score of every stable (user, book) pair.

    With boost = 1 + the family's total weight, every stable pair outranks
    every non-stable pair.  Adds ``stable`` (boolean).
    """
    s = stable.select(USER, BOOK).withColumn("stable", F.lit(True))
    b = boost if isinstance(boost, Column) else F.lit(int(boost))
    return (
        votes.join(s, [USER, BOOK], "left")
        .withColumn("stable", F.coalesce("stable", F.lit(False)))
        .withColumn("score", F.when(F.col("stable"), F.col("score") + b).otherwise(F.col("score")).cast("long"))
    )


def family_boost(weights: DataFrame, variants: Sequence[str]) -> Column:
    """Default boost: 1 micro-vote + the sum of the family's weights (lazy)."""
    tot = weights.filter(F.col(MODEL).isin(list(variants))).select(F.coalesce(F.sum(WEIGHT), F.lit(0))).scalar()
    return (tot + 1).cast("long")


def integrate_family(
    df: DataFrame,
    family: str,
    weights: DataFrame,
    variants: Sequence[str] | None = None,
    k: int = 10,
    min_support: int = 7,
    positional: str = "linear",
    boost: int | None = None,
    name: str | None = None,
    min_score: int | None = None,
    truth: DataFrame | None = None,
    list_bound: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Merge a family's variants into ONE voter for Layer 2 (P1 core).

    ``min_score`` (micro-votes) is the second reading of "seven or above":
    keep pairs whose fused score (after the boost) reaches it; it applies in
    addition to ``min_support`` (pass ``min_support=1`` to use it alone).

    Variants are standardised inside each list (O06, by rank), weighted and
    fused with positional ballots over their Top-k; pairs all variants agree on
    (the stable set) are boosted above every other pair; only pairs listed by at
    least ``min_support`` variants are kept.  Books are ranked by fused score,
    then by the sum of their standardised scores over the variants, then by
    book.  With ``truth`` (validation users) the sum is that of calibrated
    probabilities instead: isotonic hits a row of the standardised score (O07).
    Both sums are in whole micro-units.  ``list_bound`` (as in O06): the rows are
    hashed by user once, and lengths, votes and ranks all reuse that; ``rows`` (about how
    many the variants have) numbers its partitions.  Output: ``predictions`` rows with
    ``model = family`` (or ``name``), raw_score = fused score.
    """
    fam = df.filter(F.col(FAMILY) == family)
    if variants is None:
        variants = sorted(r[0] for r in fam.select(MODEL).distinct().collect())
    variants = list(variants)
    fam = fam.filter(F.col(MODEL).isin(variants))
    rank = lambda df: standardize(df, "rank", out="_std", list_bound=list_bound)
    by = [USER] if rows is None else [partitions_for(fam, rows, BALLOTS_EACH), USER]
    scaled = rank(fam if list_bound is None else fam.repartition(*by))
    micro = F.floor(F.col("_std") * MICRO)
    if truth is not None:
        # a list belongs to one user, so the fit needs the validation users' lists only
        seen = rank(fam.join(truth.select(USER), USER, "left_semi"))
        scaled = isotonic_scores(scaled, fitted_blocks(seen, truth, "_std"), "_std", "_block")
        micro = F.coalesce(idiv(F.col("_block.hits") * MICRO, F.col("_block.n")), F.lit(0))
    cast = attach_weights(scaled.filter(F.col(RNK) <= k), weights, validate=False)
    cast = cast.select(USER, BOOK, ballot_value(k, positional).alias("value"), micro.cast("long").alias("_scale"))
    cast = cast.repartition(USER) if list_bound is None else cast
    votes = cast.groupBy(USER, BOOK).agg(F.sum("value").cast("long").alias("score"), F.count(F.lit(1)).alias("support"), F.sum("_scale").alias("_scale"))
    # After conform each (model, user, book) is unique, so the pairs every
    # registered variant lists (O15's stable set) are exactly the votes with
    # support = N: the boost reads the vote aggregate, no second pass or join.
    n = len(set(variants))
    b = family_boost(weights, variants) if boost is None else F.lit(int(boost))
    boosted = votes.withColumn(
        "score", F.when(F.col("support") == n, F.col("score") + b).otherwise(F.col("score")).cast("long")
    ).filter(F.col("support") >= min_support)
    if min_score is not None:
        boosted = boosted.filter(F.col("score") >= min_score)
    # each variant lists at most k books per user
    order = Window.partitionBy(USER).orderBy(F.col("score").desc(), F.col("_scale").desc(), F.col(BOOK).asc())
    return boosted.select(
        F.lit(name or family).alias(MODEL),
        F.lit(family).alias(FAMILY),
        USER,
        BOOK,
        F.col("score").cast("double").alias(RAW),
        F.row_number().over(order).cast("int").alias(RNK),
    )


def topk_fusion(
    df: DataFrame, weights: DataFrame, k: int = 10, name: str = "top10", validate: bool | str = True, rows: int | None = None
) -> DataFrame:
    """Weighted fusion to the best ``k`` books per user (linear ballots; ``rows`` as in O17).

    Output: model (= ``name``), family, user_id, book_id, raw_score (fused
    score), rnk (arbitration rank <= k), support, best_priority.
    """
    votes = weighted_vote(df, weights, k=k, positional="linear", validate=validate, rows=rows)
    ranked = arbitrate(votes).filter(F.col("arb_rank") <= k)
    return ranked.select(
        F.lit(name).alias(MODEL),
        F.lit(name).alias(FAMILY),
        USER,
        BOOK,
        F.col("score").cast("double").alias(RAW),
        F.col("arb_rank").cast("int").alias(RNK),
        "support",
        "best_priority",
    )
