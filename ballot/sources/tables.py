"""Canonical inputs derived from the test tables (FIXTURES.md §3).

Each reader selects only the columns it needs, so the parquet scan is pruned,
and applies date filters before the join, so they are pushed into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballot.functions import partitions_for
from ballot.schema import BOOK, USER

# Line items that a task joins to their orders and sorts by user.
LINES_EACH = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _since(col: str, since: str | None):
    return F.lit(True) if since is None else F.col(col) >= F.lit(since).cast("timestamp_ntz")


def tpch_interactions(spark: SparkSession, sf_dir: str, since: str | None = None) -> DataFrame:
    """Borrowing events: user = o_custkey, book = l_partkey, ts = o_orderdate.

    ``seq`` orders borrows inside one timestamp: later order first, and inside
    one order the lower line number counts as later (line numbers are 1..7).

    Beyond ``LINES_EACH`` line items a core both sides are dealt by order to partitions
    numbered by the line items, so that neither a scan split nor a merged partition sets
    how many borrows a task sorts.
    """
    orders = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_orderdate")
        .filter(_since("o_orderdate", since))
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    parts = partitions_for(lines, lines.count(), LINES_EACH)
    if parts > spark.sparkContext.defaultParallelism:
        orders, lines = orders.repartition(parts, "o_orderkey"), lines.repartition(parts, "l_orderkey")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        F.col("o_custkey").cast("long").alias(USER),
        F.col("l_partkey").cast("long").alias(BOOK),
        F.col("o_orderdate").alias("ts"),
        (F.col("o_orderkey") * 10 + (9 - F.col("l_linenumber"))).cast("long").alias("seq"),
    )


def users(spark: SparkSession, sf_dir: str, group: str | None = "c_mktsegment") -> DataFrame:
    cols = [F.col("c_custkey").cast("long").alias(USER)]
    if group:
        cols.append(F.col(group).cast("string").alias("grp"))
    return table(spark, sf_dir, "customer").select(*cols)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("long").alias(BOOK), F.col("p_brand").alias("brand"), F.col("p_name").alias("title")
    )


def book_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book embeddings: ``vec_id`` is the part key; only some books have one."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias(BOOK), "embedding")
