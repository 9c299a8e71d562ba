"""Broadcast only behind a size check.

A side is broadcast when it has at most ``max_rows`` rows.  The check runs a
``limit(max_rows + 1).count()`` job, which stops after ``max_rows + 1`` rows.
When the side is an aggregate of a large table it is written to the shared
checkpoint folder first, so the check and the join share one computation and
nothing stays cached.  Above the bound the join is left to
Catalyst and AQE (sort-merge, or a runtime broadcast if statistics allow).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballot.session import freed_shuffles, scratch_path

# One row per model, per scenario or per group; far above any real model count,
# far below what a broadcast can carry.
MAX_BROADCAST_ROWS = 100_000


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, cache: bool = False) -> DataFrame:
    if cache:
        path = scratch_path(df.sparkSession, "small")
        with freed_shuffles(df.sparkSession):
            df.write.parquet(path)
        df = df.sparkSession.read.parquet(path)
    with freed_shuffles(df.sparkSession):
        n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def scalar_count(df: DataFrame) -> Column:
    """Row count of ``df`` as a lazy scalar subquery (no driver round trip)."""
    return df.select(F.count(F.lit(1))).scalar()


def partitions_for(df: DataFrame, rows: int, rows_each: int) -> int:
    """Partitions of about ``rows_each`` of ``rows`` rows, one for each core at least: given
    to ``repartition`` by number, they are not merged again however well the rows compress,
    so what a task sorts or groups does not grow with the input."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_each))
