"""Connected components of a large edge list, by alternating stars.

Every round joins each node to the smallest node it knows, first among its
larger neighbours, then among its smaller ones, until the edges stop changing;
then every node points to the smallest node of its component.  The number of
rounds is about logarithmic.  Each round is written to the shared checkpoint
folder, so plans stay short and a lost executor costs one round's tasks.
Smallest neighbours are aggregated map-side, and joins on a hot node are
left to Spark's skew splitting; no node's neighbours are collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballot.session import scratch_path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _star(out: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the smallest of u and its neighbours."""
    least = out.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    return out.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (columns a and b), comp being
    the smallest node of its component.  No edges give no rows."""
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star = _star(large)
        down = star.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(down.unionByName(star.select("u", F.col("m").alias("v"))).distinct(), "edges")
        then, state = state, now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == then:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, comp) of the components ``comp`` joined by further ``links`` (a, b).

    Only the links between components, which are few, go through the rounds.
    """
    if comp is None:
        return staged(components(links), "comp")
    of = comp.select("node", F.col("comp").alias("_c"))
    ends = links.join(of.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("_c", "a").alias("a"), "b")
    ends = ends.join(of.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("_c", "b").alias("b"))
    to = staged(components(ends).select(F.col("node").alias("_c"), F.col("comp").alias("_to")), "comp-to")
    old = comp.join(to.withColumnRenamed("_c", "comp"), "comp", "left").select("node", F.coalesce("_to", "comp").alias("comp"))
    new = to.join(comp.select(F.col("node").alias("_c")), "_c", "left_anti").select(F.col("_c").alias("node"), F.col("_to").alias("comp"))
    return staged(old.unionByName(new), "comp")
