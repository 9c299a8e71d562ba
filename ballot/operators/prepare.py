"""O05 conform, O06 standardize, O07 calibrate.

Partitioning: in the common case ``conform`` hashes rows by (model, user_id)
once; the dedupe aggregate on (model, family, user_id, book_id) and the
ranking window on (model, user_id) both reuse that partitioning, so conform
costs one exchange.  When a (model, user) list may be huge (no proven bound
and a sample says so) the dedupe hashes on all four keys and the ranking runs
across many tasks (``ballot.functions.rank``), so no list is held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballot.functions import bounded_broadcast, clean_score, partitions_for, safe_ratio
from ballot.functions.rank import HOT_LIST_ROWS, hot_groups, rank_within
from ballot.operators.isotonic import isotonic_blocks, isotonic_scores, rate
from ballot.schema import BOOK, FAMILY, MODEL, RAW, RNK, USER

# List rows that a task of conform sorts.
ROWS_EACH = 500_000

STD_METHODS = ("minmax", "zscore", "rank")


def _with_optional(df: DataFrame) -> DataFrame:
    if RAW not in df.columns:
        df = df.withColumn(RAW, F.lit(None).cast("double"))
    if RNK not in df.columns:
        df = df.withColumn(RNK, F.lit(None).cast("int"))
    return df


def list_order():
    """Order inside one (model, user) list: given rank, else score, then book."""
    return [F.col("_given").asc_nulls_last(), F.col(RAW).desc_nulls_last(), F.col(BOOK).asc()]


def conform(
    df: DataFrame,
    list_bound: int | None = None,
    hot_rows: int = HOT_LIST_ROWS,
    sample_fraction: float | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Drop null keys, clean scores, dedupe (model, user, book), rank gap-free.

    Duplicate pairs keep the max score, the min given rank and the first
    family by name (the model's name without a family column).  A given rank
    decides the order; otherwise ``raw_score DESC NULLS LAST``; then
    ``book_id ASC``.  Idempotent: a second pass reproduces the same ranks.

    ``list_bound``: a proven upper bound on rows per (model, user) list, e.g.
    the depth of a Top-k file.  Without it, list sizes are estimated from a
    sample; lists of about ``hot_rows`` rows or more are then deduplicated by
    model, user and book and ranked across many tasks (``functions.rank``), while
    the common case keeps the single-exchange plan.  ``rows``: about how many rows
    there are; partitions are then numbered by it, so that what a task sorts stays
    the same for any input.
    """
    df = _with_optional(df)
    family = [F.col(FAMILY).cast("string").alias(FAMILY)] if FAMILY in df.columns else []
    clean = df.filter(F.col(MODEL).isNotNull() & F.col(USER).isNotNull() & F.col(BOOK).isNotNull()).select(
        F.col(MODEL).cast("string").alias(MODEL),
        *family,
        F.col(USER),  # key types are kept: LONG by default, STRING accepted
        F.col(BOOK),
        clean_score(RAW).alias(RAW),
        F.col(RNK).cast("int").alias("_given"),
    )
    hot = None
    if list_bound is None or list_bound >= hot_rows:
        hot = hot_groups(clean, [MODEL, USER], hot_rows, sample_fraction)
    keys = [MODEL, USER, BOOK]
    # without the family, a string, the aggregate needs no sort
    aggs = [*([F.min(FAMILY).alias(FAMILY)] if family else []), F.max(RAW).alias(RAW), F.min("_given").alias("_given")]
    if hot is None:
        by = [MODEL, USER] if rows is None else [partitions_for(clean, rows, ROWS_EACH), MODEL, USER]
        dedup = clean.repartition(*by).groupBy(*keys).agg(*aggs)
    else:
        # hashed on all three keys: a hot list is spread by book, partial aggregation on
        dedup = clean.groupBy(*keys).agg(*aggs)
    ranked = rank_within(dedup, [MODEL, USER], list_order(), "_rnk", hot)
    return ranked.select(MODEL, F.col(FAMILY if family else MODEL).alias(FAMILY), USER, BOOK, RAW, F.col("_rnk").cast("int").alias(RNK))


def standardize(
    df: DataFrame, method: str = "rank", scope: str = "model", col: str = RAW, out: str = "std_score", list_bound: int | None = None
) -> DataFrame:
    """Add ``std_score``: scale differences removed inside each model's file.

    ``scope="model"`` computes the statistics over the whole model file (one
    small aggregate, broadcast after a size check); ``"model_user"`` over each
    (model, user) list (aggregate joined back on the list key).
    ``rank`` is (n - rnk + 1) / n with n the list length per (model, user).
    NULL in gives NULL out, except for ``rank``.  ``list_bound``: a proven upper bound
    on rows per list, as in ``conform``; ``rank`` then counts each list in a window,
    with one exchange (none for rows hashed by user) and no join.
    """
    if method not in STD_METHODS:
        raise ValueError(f"unknown method {method!r}; use one of {STD_METHODS}")
    if scope not in ("model", "model_user"):
        raise ValueError("scope must be 'model' or 'model_user'")
    x = F.col(col)
    # Per-list statistics as aggregate + join rather than a window: after
    # conform's single-exchange plan both sides are already partitioned by
    # (model, user) (no extra exchange), and a very long list is partially
    # aggregated instead of being held by one window task.
    if method == "rank" and list_bound is not None and list_bound < HOT_LIST_ROWS:
        keyed = df.filter(F.col(MODEL).isNotNull() & F.col(USER).isNotNull())
        n = F.count(F.lit(1)).over(Window.partitionBy(USER, MODEL))
        return keyed.withColumn("_n", n).withColumn(out, ((F.col("_n") - F.col(RNK) + 1) / F.col("_n")).cast("double")).drop("_n")
    if method == "rank":
        n = df.groupBy(MODEL, USER).agg(F.count(F.lit(1)).alias("_n"))
        res = df.join(n, [MODEL, USER], "inner")
        return res.withColumn(out, ((F.col("_n") - F.col(RNK) + 1) / F.col("_n")).cast("double")).drop("_n")

    stats_cols = [F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_sd")]
    if scope == "model_user":
        stats_df = df.join(df.groupBy(MODEL, USER).agg(*stats_cols), [MODEL, USER], "inner")
    else:
        stats = df.groupBy(MODEL).agg(*stats_cols)
        stats_df = df.join(bounded_broadcast(stats, cache=True), MODEL, "left")
    lo, hi, mean, sd = F.col("_lo"), F.col("_hi"), F.col("_mean"), F.col("_sd")

    if method == "minmax":
        val = F.when(x.isNull(), None).when(hi == lo, F.lit(1.0)).otherwise(safe_ratio(x - lo, hi - lo))
    else:
        val = F.when(x.isNull(), None).when(sd == 0, F.lit(0.0)).otherwise(safe_ratio(x - mean, sd))
    return stats_df.withColumn(out, val.cast("double")).drop("_lo", "_hi", "_mean", "_sd")


def calibrate(df: DataFrame, truth: DataFrame, method: str = "bins", n_bins: int = 10) -> DataFrame:
    """Add ``cal_score``: a comparable hit probability per model score.

    ``bins``: bin = least(n_bins - 1, floor(minmax * n_bins)) of the model-wide
    min-max score; probability = (hits + 1) / (rows + 2) per (model, bin),
    fitted on the users in ``truth`` only (pass validation users).  A bin the
    validation users never reach falls back to the model-wide rate.
    ``isotonic``: hits of a row of the score's block, where blocks are the
    isotonic regression of hits on scores, fitted on the same rows for all
    models in one plan (``operators.isotonic``).  A score between two blocks
    takes the lower one; NULL for models that no user in ``truth`` has.
    """
    scored = standardize(df, "minmax", "model", out="_mm")
    if method == "isotonic":
        return _calibrate_isotonic(scored, truth)
    if method != "bins":
        raise ValueError("method must be 'bins' or 'isotonic'")
    # a NULL score has no bin (least would skip the NULL) and gets the model-wide rate
    bin_ = F.least(F.lit(n_bins - 1), F.floor(F.col("_mm") * n_bins).cast("int"))
    binned = scored.withColumn("_bin", F.when(F.col("_mm").isNotNull(), bin_))
    t = truth.select(F.col(USER), F.col(BOOK).alias("_truth"))
    val = binned.join(t, USER, "inner").withColumn("_hit", (F.col(BOOK) == F.col("_truth")).cast("long"))
    # one pass over the validation rows; the model-wide rate rolls its bins up
    per_bin = val.groupBy(MODEL, "_bin").agg(F.sum("_hit").alias("_h"), F.count(F.lit(1)).alias("_n"))
    per_bin = bounded_broadcast(per_bin, cache=True)
    rate = lambda h, n: ((h + 1) / (n + 2)).cast("double")
    per_model = per_bin.groupBy(MODEL).agg(rate(F.sum("_h"), F.sum("_n")).alias("_p_model"))
    bins = per_bin.select(MODEL, "_bin", rate(F.col("_h"), F.col("_n")).alias("_p_bin"))
    out = binned.join(bins, [MODEL, "_bin"], "left").join(per_model, MODEL, "left")
    return out.withColumn("cal_score", F.coalesce("_p_bin", "_p_model", F.lit(0.5))).drop(
        "_mm", "_bin", "_p_bin", "_p_model"
    )


def fitted_blocks(df: DataFrame, truth: DataFrame, col: str) -> DataFrame:
    """The isotonic blocks of the score ``col``, fitted on the users in ``truth``."""
    t = truth.select(F.col(USER), F.col(BOOK).alias("_truth"))
    hit = F.coalesce(F.col(BOOK) == F.col("_truth"), F.lit(False)).cast("long")
    return isotonic_blocks(df.join(t, USER, "inner").select(MODEL, F.col(col).alias("x"), hit.alias("hit")))


def _calibrate_isotonic(scored: DataFrame, truth: DataFrame) -> DataFrame:
    return isotonic_scores(scored, fitted_blocks(scored, truth, "_mm"), "_mm", "_block").withColumn("cal_score", rate("_block")).drop("_mm", "_block")
