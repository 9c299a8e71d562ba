"""Exact per-group ranking that stays parallel when one group is huge.

``row_number() OVER (PARTITION BY g ORDER BY k)`` puts each group in one task.
When a group may hold a large share of all rows, ``rank_within``:

1. estimates group sizes from a small sample (``hot_rows`` sets what counts as
   hot; the sample only decides the plan, never the result);
2. ranks ordinary groups with the plain window;
3. sorts the rows of hot groups globally (range partitioning spreads one group
   over many partitions), tags each row with its range partition, and writes
   that once to the checkpoint folder so both uses below see the same
   partition ids;
4. ranks inside each (group, partition) block with a window (blocks are
   bounded by the range partition size), and adds the number of rows of the
   same group in earlier partitions, a prefix sum over a table with one row
   per (hot group, partition), broadcast after a size check.

The result equals the plain window for any data; a test checks this.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballot.functions.small import bounded_broadcast
from ballot.session import checkpoint_dir

# A (model, user) list longer than this is ranked across many tasks.
HOT_LIST_ROWS = 1_000_000


def _window_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("int"))


def hot_groups(df: DataFrame, group: Sequence[str], hot_rows: int, fraction: float | None = None, seed: int = 17):
    """Groups estimated to hold at least about ``hot_rows`` rows, or None.

    Samples about 100 rows per hot-sized group; returns a (checked, cached)
    frame of group keys, or None when there is none.
    """
    f = fraction if fraction is not None else min(1.0, 100.0 / hot_rows)
    est = (
        df.select(*group)
        .sample(withReplacement=False, fraction=f, seed=seed)
        .groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") * (1.0 / f) >= hot_rows * 0.5)
        .select(*group)
    )
    hot = bounded_broadcast(est.withColumn("_hot", F.lit(True)), cache=True)
    return hot if hot.limit(1).count() > 0 else None


def rank_within(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    out: str = "rnk",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Exact ``row_number()`` per group; ``hot`` (from ``hot_groups``) names
    the groups to rank across many tasks.  Without ``hot`` this is the plain
    window."""
    group = list(group)
    if hot is None:
        return _window_rank(df, group, order, out)
    tagged = df.join(hot, group, "left")
    normal = _window_rank(tagged.filter(F.col("_hot").isNull()).drop("_hot"), group, order, out)

    big = tagged.filter(F.col("_hot").isNotNull()).drop("_hot")
    spread = big.orderBy(*[F.col(g).asc() for g in group], *order).withColumn("_pid", F.spark_partition_id())
    checkpoint_dir(df.sparkSession)  # the shared folder named by spark.checkpoint.dir
    spread = spread.checkpoint(eager=True)  # fixes partition ids for both uses below
    local = _window_rank(spread, group + ["_pid"], order, "_lr")
    blocks = spread.groupBy(*group, "_pid").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))).select(*group, "_pid", "_off")
    ranked = (
        local.join(bounded_broadcast(offsets, cache=True), group + ["_pid"], "inner")
        .withColumn(out, (F.col("_off") + F.col("_lr")).cast("int"))
        .drop("_pid", "_lr", "_off")
    )
    return normal.unionByName(ranked)
