"""Layer 2: O11 consensus_filter, O14 cascade, O16 union_models, O17
weighted_vote, O21 arbitrate, O22 top1, O23 decision_margin.

Partitioning: ``weighted_vote`` keeps only ballots (rnk <= k, at most
models x k rows per user), joins the broadcast weights and hashes the ballots
by user once.  The (user, book) aggregate and every later window on user reuse
that partitioning: vote -> arbitrate -> top1 is a single exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballot.functions import idiv, partitions_for
from ballot.operators.weights import attach_weights
from ballot.schema import BOOK, MODEL, PRIORITY, RNK, USER, WEIGHT

# Ballots that a task adds up.
BALLOTS_EACH = 500_000

POSITIONAL = ("flat", "linear", "reciprocal")


def ballot_value(k: int, positional: str = "flat"):
    """Value of one ballot in micro-votes; integer division per ballot."""
    w, r = F.col(WEIGHT), F.col(RNK)
    if positional == "flat":
        return w
    if positional == "linear":
        return idiv(w * (F.lit(k) - r + 1), F.lit(k))
    if positional == "reciprocal":
        return idiv(w, r)
    raise ValueError(f"positional must be one of {POSITIONAL}")


def ballots(
    df: DataFrame, weights: DataFrame, k: int = 1, positional: str = "flat", validate: bool | str = True, rows: int | None = None
) -> DataFrame:
    """One row per (model, user, book) with rnk <= k, valued and hashed by user.  ``rows``:
    about how many ballots there are; partitions are then numbered by it."""
    b = attach_weights(df.filter(F.col(RNK) <= k), weights, validate=validate)
    by = [USER] if rows is None else [partitions_for(df, rows, BALLOTS_EACH), USER]
    return b.select(USER, BOOK, MODEL, RNK, PRIORITY, ballot_value(k, positional).cast("long").alias("value")).repartition(*by)


def weighted_vote(
    df: DataFrame, weights: DataFrame, k: int = 1, positional: str = "flat", validate: bool | str = True, rows: int | None = None
) -> DataFrame:
    """Sum ballot values per (user, book).  The raw score is never read.  ``rows`` as in ``ballots``.

    Output ``votes``: user_id, book_id, score (LONG), support (distinct models),
    best_priority (strongest model that voted for the pair).
    """
    b = ballots(df, weights, k, positional, validate, rows)
    return b.groupBy(USER, BOOK).agg(
        F.sum("value").cast("long").alias("score"),
        F.count(F.lit(1)).cast("long").alias("support"),
        F.min(PRIORITY).cast("int").alias("best_priority"),
    )


def consensus_filter(votes: DataFrame, m: int = 2) -> DataFrame:
    """Keep pairs supported by at least ``m`` distinct voters."""
    return votes.filter(F.col("support") >= m)


def arbitration_order():
    """Total order: score desc, support desc, best_priority asc, book asc."""
    return [
        F.col("score").desc_nulls_last(),
        F.col("support").desc_nulls_last(),
        F.col("best_priority").asc_nulls_last(),
        F.col(BOOK).asc_nulls_last(),
    ]


def arbitrate(votes: DataFrame) -> DataFrame:
    """Add ``arb_rank``: a deterministic total order of candidates per user."""
    w = Window.partitionBy(USER).orderBy(*arbitration_order())
    return votes.withColumn("arb_rank", F.row_number().over(w).cast("int"))


def top1_by_consensus(votes: DataFrame, m: int = 2) -> DataFrame:
    """Per user the best pair with at least ``m`` voters, else the best pair:
    consensus and plain vote in one window, named in ``source``."""
    agreed = F.col("support") >= m
    w = Window.partitionBy(USER).orderBy(agreed.desc_nulls_last(), *arbitration_order())
    best = votes.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
    source = F.when(agreed, F.lit("consensus")).otherwise(F.lit("vote"))
    return best.select(USER, BOOK, F.col("score").cast("long").alias("score"), source.alias("source"))


def top1(votes: DataFrame, source: str = "vote") -> DataFrame:
    """Unique, stable Top-1 per user: ``picks(user_id, book_id, score, source)``.

    The filter sits directly on ``row_number`` so Catalyst plans a
    ``WindowGroupLimit``.
    """
    return (
        arbitrate(votes)
        .filter(F.col("arb_rank") == 1)
        .select(USER, BOOK, F.col("score").cast("long").alias("score"), F.lit(source).alias("source"))
    )


def decision_margin(votes: DataFrame) -> DataFrame:
    """Winner's lead over the runner-up; 0 runner-up score if alone.

    If margin > W, no additional ballots of total weight <= W per user can
    change the pick (flat ballots, non-negative weights, before O11).
    Output: user_id, book_id, score, runner_up, margin.
    """
    w = Window.partitionBy(USER).orderBy(*arbitration_order())
    ranked = votes.withColumn("arb_rank", F.row_number().over(w)).withColumn(
        "runner_up", F.coalesce(F.lead("score").over(w), F.lit(0)).cast("long")
    )
    return ranked.filter(F.col("arb_rank") == 1).select(
        USER, BOOK, "score", "runner_up", (F.col("score") - F.col("runner_up")).cast("long").alias("margin")
    )


def cascade(sources: Sequence[tuple[str | None, DataFrame]]) -> DataFrame:
    """Per user, the pick of the first source (in list order) that has the user.

    ``sources``: ordered ``(name, picks)`` pairs; each picks frame has at most
    one row per user.  Output ``picks`` with ``source`` = the name used, or the
    frame's own ``source`` where the name is None.
    """
    if not sources:
        raise ValueError("cascade needs at least one source")
    parts = [
        p.select(
            F.col(USER),
            F.col(BOOK),
            (F.col("score") if "score" in p.columns else F.lit(None)).cast("long").alias("score"),
            (F.col("source") if name is None else F.lit(name)).alias("source"),
            F.lit(i).alias("_order"),
        )
        for i, (name, p) in enumerate(sources)
    ]
    allp = reduce(DataFrame.unionByName, parts).filter(F.col(USER).isNotNull() & F.col(BOOK).isNotNull())
    w = Window.partitionBy(USER).orderBy(F.col("_order").asc(), F.col(BOOK).asc())
    return allp.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn", "_order")


def union_models(dfs: Sequence[DataFrame]) -> DataFrame:
    """Put all models' lists together (columns matched by name)."""
    if not dfs:
        raise ValueError("union_models needs at least one frame")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
