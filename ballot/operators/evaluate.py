"""Evaluation: O13 supplementary, O24 hit_at_k, O25 temporal_holdout,
O26 variant_stability, O27 admission_scenarios, O28 admission_gate,
O29 pair_lift, O30 submission_check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballot.functions import bounded_broadcast, safe_ratio, scalar_count
from ballot.operators.layer2 import arbitration_order, ballots, top1, weighted_vote
from ballot.schema import BOOK, FAMILY, MODEL, PRIORITY, RNK, USER, WEIGHT
from ballot.session import scratch_path


# --------------------------------------------------------------------- O13


def supplementary(new: DataFrame, backbone: DataFrame, k: int = 10) -> DataFrame:
    """Pairs in ``new``'s Top-k that no backbone model has in its Top-k.

    The backbone's pairs grow with users x models x k and their size is not known
    before the run, so they are joined by sort-merge and never gathered for a broadcast.
    """
    b = backbone.filter(F.col(RNK) <= k).select(USER, BOOK).hint("merge")
    return new.filter(F.col(RNK) <= k).join(b, [USER, BOOK], "left_anti")


# --------------------------------------------------------------------- O24


def hit_at_k(preds: DataFrame, truth: DataFrame, k: int = 1, name: str = "picks") -> DataFrame:
    """Top-k accuracy per model: one row ``model, n_users, hits, rate``.

    The denominator is every user in ``truth``.  A picks frame (no ``rnk``,
    no ``model``) counts as one model named ``name`` with rank 1.
    """
    if RNK not in preds.columns:
        preds = preds.withColumn(RNK, F.lit(1))
    if MODEL not in preds.columns:
        preds = preds.withColumn(MODEL, F.lit(name))
    t = truth.select(USER, F.col(BOOK).alias("_truth"))
    top = preds.filter(F.col(RNK) <= k)
    hits = (
        top.join(t, USER, "inner")
        .filter(F.col(BOOK) == F.col("_truth"))
        .groupBy(MODEL)
        .agg(F.count_distinct(USER).alias("hits"))
    )
    n = scalar_count(truth).cast("long")
    return (
        preds.select(MODEL)
        .distinct()
        .join(hits, MODEL, "left")
        .select(MODEL, n.alias("n_users"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
        .withColumn("rate", safe_ratio("hits", "n_users"))
    )


# --------------------------------------------------------------------- O25


def temporal_holdout(
    interactions: DataFrame, folds: int = 5, split_col: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Truth = last borrow per user; train = borrows strictly before it.

    Last = ``ts DESC, seq DESC, book_id ASC``.  ``split`` is 'validation' when
    ``pmod(user_id, folds) = 0``, else 'test'; with STRING keys the caller
    names a column ``split_col`` (on ``interactions``, constant per user)
    holding 'validation' or 'test'.  Returns ``(truth, train)``.
    The ``row_number() = 1`` filter becomes a WindowGroupLimit, so a user with
    a huge history is cut to one row per partition before the shuffle.
    """
    w = Window.partitionBy(USER).orderBy(F.col("ts").desc_nulls_last(), F.col("seq").desc(), F.col(BOOK).asc())
    last = (
        interactions.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") == 1)
        .select(
            USER,
            BOOK,
            "ts",
            (
                F.col(split_col)
                if split_col
                else F.when(F.pmod(F.col(USER), F.lit(folds)) == 0, F.lit("validation")).otherwise(F.lit("test"))
            ).alias("split"),
        )
    )
    return last, train_before(interactions, last)


def train_before(interactions: DataFrame, truth: DataFrame) -> DataFrame:
    """The borrows strictly before each user's last one."""
    cut = truth.select(USER, F.col("ts").alias("_cut"))
    return interactions.join(cut, USER, "inner").filter(F.col("ts") < F.col("_cut")).drop("_cut")


# --------------------------------------------------------------------- O26


def variant_stability(df: DataFrame, family: str, k: int = 10, variants: Sequence[str] | None = None) -> DataFrame:
    """How much predictions move between variants of one family.

    Per ordered variant pair (a, b): ``users_both`` (users listed by both),
    ``same_top1``, ``inter`` = sum |A ∩ B| and ``union`` = sum |A ∪ B| over
    users in both, and ``jaccard`` = inter / union.

    Two aggregates give the sorted set of variants (numbers) that list each
    (user, book), and each user's variants with their list sizes.  Both are
    counted by distinct set, and only distinct sets are exploded into variant
    pairs: nothing is paired per user, and any number of variants will do.
    """
    fam = df.filter((F.col(FAMILY) == family) & (F.col(RNK) <= k))
    if variants is None:
        variants = sorted(r[0] for r in fam.select(MODEL).distinct().collect())
    variants = list(variants)
    number = F.array_position(F.array(*[F.lit(v) for v in variants]), F.col(MODEL)).cast("int")
    fam = fam.filter(F.col(MODEL).isin(variants)).select(USER, BOOK, RNK, number.alias("_v"))

    def variant_set(when: Column | None = None) -> Column:
        return F.sort_array(F.collect_set(F.col("_v") if when is None else F.when(when, F.col("_v"))))

    # a set holds one number a variant at most
    pair = fam.groupBy(USER, BOOK).agg(variant_set().alias("_set"), variant_set(F.col(RNK) == 1).alias("_first"))
    sizes = fam.groupBy(USER, "_v").agg(F.count_distinct(BOOK).alias("_n"))
    per_user = sizes.groupBy(USER).agg(
        variant_set().alias("_set"), F.map_from_entries(F.collect_list(F.struct("_v", "_n"))).alias("_sizes")
    )
    n_of = [F.sum(F.coalesce(F.try_element_at("_sizes", F.lit(i + 1)), F.lit(0))) for i in range(len(variants))]
    per_set = per_user.groupBy("_set").agg(F.count(F.lit(1)).alias("_users"), F.array(*n_of).alias("_sums"))

    def by_pair(sets: DataFrame, *aggs: Column) -> DataFrame:
        return sets.withColumn("_a", F.explode("_set")).withColumn("_b", F.explode("_set")).filter("_a <> _b").groupBy("_a", "_b").agg(*aggs)

    both = by_pair(
        per_set,
        F.sum("_users").cast("long").alias("users_both"),
        F.sum(F.get("_sums", F.col("_a") - 1) + F.get("_sums", F.col("_b") - 1)).cast("long").alias("_listed"),
    )
    inter = by_pair(pair.groupBy("_set").agg(F.count(F.lit(1)).alias("_c")), F.sum("_c").cast("long").alias("inter"))
    first = pair.filter(F.size("_first") > 1).groupBy(F.col("_first").alias("_set")).agg(F.count(F.lit(1)).alias("_c"))
    same = by_pair(first, F.sum("_c").cast("long").alias("same_top1"))
    names = [(i + 1, j + 1, a, b) for i, a in enumerate(variants) for j, b in enumerate(variants) if i != j]
    keys = ["_a", "_b"]
    out = (
        df.sparkSession.createDataFrame(names, "_a int, _b int, model_a string, model_b string")
        .join(both, keys, "left")
        .join(same, keys, "left")
        .join(inter, keys, "left")
        .na.fill(0, ["users_both", "same_top1", "inter", "_listed"])
        .select("model_a", "model_b", "users_both", "same_top1", "inter", (F.col("_listed") - F.col("inter")).alias("union"))
    )
    return out.withColumn("jaccard", safe_ratio("inter", "union"))


# --------------------------------------------------------------------- O27


def admission_scenarios(
    df: DataFrame,
    weights: DataFrame,
    backbone: Sequence[str],
    candidates: Sequence[str],
    truth: DataFrame,
    cap: int | None = None,
    k: int = 1,
) -> DataFrame:
    """Score of the backbone alone (scenario 0) and backbone + each candidate.

    Candidate i enters at ``least(weight, cap)``.  Adding one model only raises
    the scores of the books that model votes for, so under the total order the
    new winner of a user is either the backbone winner or one of those books.
    Each scenario therefore needs only the candidate's ballots, joined to the
    backbone votes; the backbone is voted once, never copied per scenario.
    Output: scenario, model, weight, n_users, hits, rate.
    """
    spark = df.sparkSession
    # Hits are counted on truth users only, so only their ballots matter.
    df = df.filter(F.col(RNK) <= k).join(truth.select(USER), USER, "left_semi")
    bb = df.filter(F.col(MODEL).isin(list(backbone)))
    bb_votes = weighted_vote(bb, weights, k=k, validate="lazy")
    bb_top = top1(bb_votes).select(USER, F.col(BOOK).alias("_b0"))
    t = truth.select(USER, F.col(BOOK).alias("_truth"))
    n = scalar_count(truth).cast("long")

    cw = weights.filter(F.col(MODEL).isin(list(candidates)))
    if cap is not None:
        cw = cw.withColumn(WEIGHT, F.least(F.col(WEIGHT), F.lit(cap)))
    cand = ballots(df.filter(F.col(MODEL).isin(list(candidates))), cw, k=k, validate="lazy").select(
        F.col(MODEL).alias("scenario_model"), USER, BOOK, "value", F.col(PRIORITY).alias("_prio")
    )
    boosted = cand.join(bb_votes, [USER, BOOK], "left").select(
        "scenario_model",
        USER,
        BOOK,
        (F.coalesce("score", F.lit(0)) + F.col("value")).cast("long").alias("score"),
        (F.coalesce("support", F.lit(0)) + 1).cast("long").alias("support"),
        F.least(F.coalesce("best_priority", F.col("_prio")), F.col("_prio")).alias("best_priority"),
    )
    touched = cand.select("scenario_model", USER).distinct()
    incumbent = touched.join(bb_votes, USER).join(bb_top, USER).filter(F.col(BOOK) == F.col("_b0")).select(
        "scenario_model", USER, BOOK, "score", "support", "best_priority"
    )
    w = Window.partitionBy("scenario_model", USER).orderBy(*arbitration_order())
    new_win = (
        boosted.unionByName(incumbent)
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") == 1)
        .select("scenario_model", USER, BOOK)
    )
    # hits change only for touched users
    delta = (
        new_win.join(bb_top, USER, "left")
        .join(t, USER, "inner")
        .groupBy("scenario_model")
        .agg(
            (
                F.sum((F.col(BOOK) == F.col("_truth")).cast("long"))
                - F.sum(F.coalesce((F.col("_b0") == F.col("_truth")).cast("long"), F.lit(0)))
            ).alias("_delta")
        )
    )
    base_hits = bb_top.join(t, USER).filter(F.col("_b0") == F.col("_truth")).select(F.count(F.lit(1))).scalar()
    scen = spark.createDataFrame(
        [(0, None)] + [(i + 1, m) for i, m in enumerate(candidates)], "scenario int, model string"
    )
    out = (
        scen.join(cw.select(MODEL, WEIGHT), MODEL, "left")
        .join(delta, scen[MODEL] == delta["scenario_model"], "left")
        .select(
            "scenario",
            MODEL,
            F.col(WEIGHT).cast("long").alias(WEIGHT),
            n.alias("n_users"),
            (base_hits + F.coalesce("_delta", F.lit(0))).cast("long").alias("hits"),
        )
    )
    return out.withColumn("rate", safe_ratio("hits", "n_users"))


# --------------------------------------------------------------------- O28


def _vote_key(score: str, support: str, priority: str, book: str) -> Column:
    """The arbitration order as one value: the smallest wins."""
    last = F.coalesce(F.col(priority), F.lit(2**31 - 1))
    return F.struct((-F.col(score)).alias("s"), (-F.col(support)).alias("n"), last.alias("p"), F.col(book).alias(BOOK))


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def admission_gate(
    df: DataFrame,
    weights: DataFrame,
    backbone: Sequence[str],
    candidates: Sequence[str],
    truth: DataFrame,
    cap: int | None = None,
    k: int = 1,
) -> DataFrame:
    """Admit candidates in the given order when validation hits do not fall.

    ``truth`` must be the validation users.  Non-degradation is guaranteed on
    those users only, not on unseen users.

    The vote is never taken again.  Three stages under ``spark.checkpoint.dir``
    hold its running state: the ballots, one folder a model; the *contested*
    pairs, which some candidate still to come votes for, with the votes they
    have so far; and the winner of each user.  Adding a model only raises the
    pairs that it votes for, so a step joins one model's ballots to their
    contested pairs, takes the best raised pair of each touched user, and
    compares it with that user's winner.  Hits are a running sum: the step's
    job returns by how much they change.  When the model is admitted, the raised
    pairs and the new winners go into the next state; pairs that no later
    candidate votes for leave it, so it shrinks.  A lost executor recomputes
    from the last state.  The driver reads one row a step.
    Output: step, model, hits_before, hits_after, admitted.
    """
    spark = df.sparkSession
    candidates, backbone = list(candidates), list(backbone)
    # A candidate enters at its capped weight and keeps it once admitted.
    if cap is not None:
        capped = F.when(F.col(MODEL).isin(candidates), F.least(F.col(WEIGHT), F.lit(cap))).otherwise(F.col(WEIGHT))
        weights = weights.withColumn(WEIGHT, capped)
    t = _staged(truth.select(USER, F.col(BOOK).alias("_truth")), "gate-truth")
    voting = df.filter((F.col(RNK) <= k) & F.col(MODEL).isin(backbone + candidates)).join(t.select(USER), USER, "left_semi")
    cast = ballots(voting, weights, k=k, validate="lazy").select(USER, BOOK, "value", F.col(PRIORITY).alias("_prio"), MODEL)
    path = scratch_path(spark, "gate-ballots")
    cast.write.partitionBy(MODEL).parquet(path)
    cast = spark.read.schema(cast.schema).parquet(path)

    base = cast.filter(F.col(MODEL).isin(backbone)).groupBy(USER, BOOK).agg(
        F.sum("value").cast("long").alias("score"), F.count(F.lit(1)).alias("support"), F.min("_prio").alias("best_priority")
    )
    base = _staged(base, "gate-votes")
    winners = base.groupBy(USER).agg(F.min(_vote_key("score", "support", "best_priority", BOOK)).alias("best"))
    winners = _staged(t.join(winners, USER, "left"), "gate-winners")
    order = spark.createDataFrame(list(enumerate(candidates, start=1)), "_step int, model string")
    last = cast.join(F.broadcast(order), MODEL).groupBy(USER, BOOK).agg(F.max("_step").alias("last"))
    contested = last.join(base, [USER, BOOK], "left").na.fill(0, ["score", "support"])
    contested = _staged(contested, "gate-contested")

    def right(best: str) -> Column:
        return F.coalesce(F.col(f"{best}.{BOOK}") == F.col("_truth"), F.lit(False)).cast("long")

    hits = int(winners.agg(F.coalesce(F.sum(right("best")), F.lit(0))).first()[0])
    rows = []
    for step, model in enumerate(candidates, start=1):
        new = cast.filter(F.col(MODEL) == model).drop(MODEL)
        raised = contested.join(new, [USER, BOOK]).select(
            USER,
            BOOK,
            "last",
            (F.col("score") + F.col("value")).alias("score"),
            (F.col("support") + 1).alias("support"),
            F.least("best_priority", "_prio").alias("best_priority"),
        )
        best = raised.groupBy(USER).agg(F.min(_vote_key("score", "support", "best_priority", BOOK)).alias("now"))
        turned = winners.join(best, USER).filter(F.col("best").isNull() | (F.col("now") < F.col("best")))
        change = turned.agg(F.coalesce(F.sum(right("now") - right("best")), F.lit(0))).first()[0]
        after = hits + int(change)
        rows.append((step, model, hits, after, after >= hits))
        if after >= hits and step < len(candidates):
            hits = after
            winners = _staged(winners.join(best, USER, "left").withColumn("best", F.least("best", "now")).drop("now"), "gate-winners")
            kept = contested.join(new.select(USER, BOOK), [USER, BOOK], "left_anti").unionByName(raised)
            contested = _staged(kept.filter(F.col("last") > step), "gate-contested")
    return spark.createDataFrame(
        rows, "step int, model string, hits_before long, hits_after long, admitted boolean"
    )


# --------------------------------------------------------------------- O29


def pair_lift(before: DataFrame, after: DataFrame, truth: DataFrame, details: bool = False) -> DataFrame:
    """Counts of users fixed / broken / both_right / both_wrong by a change.

    With ``details`` the affected users instead: one row per user whose
    outcome changed, ``user_id, truth, before, after, change`` ('fixed' or
    'broken').
    """
    t = truth.select(USER, F.col(BOOK).alias("_truth"))
    b = before.select(USER, F.col(BOOK).alias("_before"))
    a = after.select(USER, F.col(BOOK).alias("_after"))
    j = t.join(b, USER, "left").join(a, USER, "left")
    rb = F.coalesce(F.col("_before") == F.col("_truth"), F.lit(False))
    ra = F.coalesce(F.col("_after") == F.col("_truth"), F.lit(False))

    if details:
        change = F.when(~rb & ra, F.lit("fixed")).when(rb & ~ra, F.lit("broken"))
        return j.select(
            USER,
            F.col("_truth").alias("truth"),
            F.col("_before").alias("before"),
            F.col("_after").alias("after"),
            change.alias("change"),
        ).filter(F.col("change").isNotNull())

    def cnt(c):
        return F.sum(c.cast("long")).cast("long")

    return j.agg(
        F.count(F.lit(1)).cast("long").alias("n_users"),
        cnt(~rb & ra).alias("fixed"),
        cnt(rb & ~ra).alias("broken"),
        cnt(rb & ra).alias("both_right"),
        cnt(~rb & ~ra).alias("both_wrong"),
    )


# --------------------------------------------------------------------- O30


def submission_check(picks: DataFrame, users: DataFrame, books: DataFrame) -> DataFrame:
    """One row: expected, delivered, missing, duplicate_users, null_keys,
    unknown_books, unknown_users."""
    u = users.select(USER).distinct().withColumn("_user", F.lit(True))
    bk = books.select(F.col(BOOK).alias("_b")).distinct().withColumn("_book", F.lit(True))
    p = picks.select(USER, F.col(BOOK).alias("_b"))
    # every pick with what is known of its user and book; users without a pick too
    known = p.withColumn("_pick", F.lit(True)).join(bk, "_b", "left")
    per_user = known.groupBy(USER).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("_b").isNull()).alias("_null_books"),
        F.count_if(F.col("_b").isNotNull() & F.col("_book").isNull()).alias("_bad_books"),
    )
    joined = per_user.join(u.withColumnRenamed(USER, "_u"), F.col(USER) == F.col("_u"), "full")
    n, real = F.col("_n"), F.col(USER).isNotNull()

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    null_keys = F.when(real, F.col("_null_books")).otherwise(n)
    bad_books = F.when(real, F.col("_bad_books"))
    stray = F.when(real & F.col("_user").isNull(), n - F.col("_null_books"))
    return joined.agg(
        F.count("_user").cast("long").alias("expected"),
        total(n).alias("delivered"),
        F.count_if(F.col("_user") & n.isNull()).cast("long").alias("missing"),
        F.count_if(real & (n > 1)).cast("long").alias("duplicate_users"),
        total(null_keys).alias("null_keys"),
        total(bad_books).alias("unknown_books"),
        total(stray).alias("unknown_users"),
    )


__all__ = [
    "admission_gate",
    "admission_scenarios",
    "bounded_broadcast",
    "hit_at_k",
    "pair_lift",
    "submission_check",
    "supplementary",
    "temporal_holdout",
    "train_before",
    "variant_stability",
]
