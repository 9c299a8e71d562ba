"""Isotonic regression of hits on scores for all models in one plan (O07).

The fit is pooling of adjacent violators (PAV): neighbouring scores whose hit
rates do not rise are pooled until the rates rise strictly.  Pooling is
associative, so it runs in levels: equal scores are added up map-side, the
scores of a model are cut into key ranges of about equal numbers of distinct
scores, each range is pooled on its own, and the pooled blocks of the ranges are
pooled again, which leaves the same blocks as one pass over all scores.  Hits and
rows are whole numbers and rates are compared by cross products, so the blocks
are exact and do not depend on partitioning.  No range is larger than its share
of the distinct scores, and what leaves a range are blocks, not scores.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballot.functions import bounded_broadcast
from ballot.schema import MODEL
from ballot.session import freed_shuffles, scratch_path

#: Key ranges of a model's scores.
RANGES = 64
_BLOCK = "lo double, hi double, n long, hits long"


def pool(blocks: Iterable[tuple[float, float, int, int]]) -> list[tuple[float, float, int, int]]:
    """PAV over (lo, hi, n, hits) in order of score: rates rise strictly after it."""
    out: list[tuple[float, float, int, int]] = []
    for lo, hi, n, hits in blocks:
        while out and out[-1][3] * n >= hits * out[-1][2]:
            lo0, _, n0, hits0 = out.pop()
            lo, n, hits = lo0, n + n0, hits + hits0
        out.append((lo, hi, n, hits))
    return out


def _pooled(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` (model, range, lo, hi, n, hits) pooled within ``keys``."""
    schema = f"{MODEL} string, range int, {_BLOCK}"

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("lo", "hi", "n", "hits"))))
        lo, hi, n, hits = (list(c) for c in zip(*pool(rows)))
        same = [table.column(MODEL)[0].as_py()] * len(lo), [table.column("range")[0].as_py()] * len(lo)
        return pa.table([pa.array(same[0], pa.string()), pa.array(same[1], pa.int32()), pa.array(lo, pa.float64()), pa.array(hi, pa.float64()), pa.array(n, pa.int64()), pa.array(hits, pa.int64())], names=[MODEL, "range", "lo", "hi", "n", "hits"])

    return df.groupBy(*keys).applyInArrow(run, schema)


def isotonic_blocks(scores: DataFrame, ranges: int = RANGES) -> DataFrame:
    """(model, lo, hi, n, hits): blocks of rising hit rates.  ``scores`` has
    model, x and hit (0 or 1); rows with a null score do not count."""
    counts = scores.filter(F.col("x").isNotNull()).groupBy(MODEL, "x").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").cast("long").alias("hits"))
    # written once: the cuts and the ranges both read the counts
    path = scratch_path(scores.sparkSession, "score-counts")
    with freed_shuffles(scores.sparkSession):
        counts.write.parquet(path)
    counts = scores.sparkSession.read.parquet(path)
    cuts = F.percentile_approx("x", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("_cuts")
    cut = counts.join(F.broadcast(counts.groupBy(MODEL).agg(cuts)), MODEL)  # one row a model
    place = F.size(F.filter("_cuts", lambda c: c < F.col("x"))).cast("int")
    parts = cut.select(MODEL, place.alias("range"), F.col("x").alias("lo"), F.col("x").alias("hi"), "n", "hits")
    return _pooled(_pooled(parts, [MODEL, "range"]), [MODEL]).select(MODEL, "lo", "hi", "n", "hits")


def isotonic_scores(df: DataFrame, blocks: DataFrame, x: str, out: str) -> DataFrame:
    """``df`` with ``out``: struct of n and hits of the block of ``x``, which is
    the last one that begins at or below it, else the first; null for a null
    score and for a model without blocks."""
    steps = blocks.groupBy(MODEL).agg(F.sort_array(F.collect_list(F.struct("lo", "n", "hits"))).alias("_steps"))
    joined = df.join(bounded_broadcast(steps, cache=True), MODEL, "left")
    below = F.filter("_steps", lambda s: s["lo"] <= F.col(x))
    block = F.coalesce(F.try_element_at(below, F.lit(-1)), F.try_element_at("_steps", F.lit(1)))
    return joined.withColumn(out, F.when(F.col(x).isNotNull(), F.struct(block["n"].alias("n"), block["hits"].alias("hits")))).drop("_steps")


def rate(block: str) -> Column:
    """Hits of a row of the block, as a double; null without a block."""
    return F.try_divide(F.col(f"{block}.hits").cast("double"), F.col(f"{block}.n"))
