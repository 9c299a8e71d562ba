"""Mixing sources to target weights by capped water-filling (operator 5).

Every source has a weight and a cap of ``epochs`` times its size in words.
The mix holds ``share`` times all words.  Its level is the words per unit of
weight: sources whose cap is below weight x level are clamped to the cap,
their excess raises the level of the others, and so on until none is above.
Each round is one aggregate over the sources; the driver sees two sums.

A source takes every document ``floor(target / size)`` times, and the rest of
its target as one more repetition of some documents in a seeded order (a hash
of the id).  These are the documents before a boundary place, which is found
by digits of the hash: each level sums the words under 1,024 values of the
next ten bits and descends into the one where the rest ends, until about
1,024 documents share it.  Only that last group of a source is gathered (its
size does not grow with the source) and filled document by document, the last
one by whichever comes nearest.  So no group grows with a hot source and no
task sees a whole source in order.

Only DataFrame functions are used.  Defined results: a null text has no
words; null sources are a source of their own, the last; repeated rows of an
id are taken or left together; sources without words have target 0; an empty
table gives an empty result; ``mix`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballot.functions import bounded_broadcast
from ballot.llm.exprs import let, n_words
from ballot.llm.graph import staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
_BITS, _DIGIT = 60, 10
#: Sources whose plans (each with the chosen ids of one group) are sent to all tasks.
MAX_BROADCAST = 1_000


def _place(doc_id: Column, seed: str) -> Column:
    """60 bits of the md5 of seed and id."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(place: Column, digits: Column) -> Column:
    """The first ``digits`` ten-bit digits of a place."""
    return F.call_function("shiftright", place, (F.lit(_BITS) - digits * _DIGIT).cast("int"))


def cycled_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Weights dealt to the sources in code point order, null last.  The
    window holds one row for each source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights)))))


def water_fill(sources: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``sources`` (source, weight, source_size) with their ``target``."""
    cap = F.col("source_size") * float(epochs)
    total = share * float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        full = cap < F.lit(level) * F.col("weight")
        n, capped, free = sources.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == clamped or not free:
            break
        level, clamped = max(total - (capped or 0.0), 0.0) / free, n
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")) if free else cap)


def plan_mix(docs: DataFrame, doc_id: str, text: str, source: str, share: float, epochs: int, seed: str, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): per document its size and place, per source its target,
    whole repetitions and boundary.  ``weights`` has (source, weight)."""
    sizes = staged(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), _place(F.col(doc_id), seed).alias("place")), "mix-sizes")
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    if weights is None:
        stats = cycled_weights(stats)
    else:
        stats = stats.alias("s").join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source"))).select("s.*", "w.weight")
    plan = water_fill(staged(stats, "mix-sources"), share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    depth = F.when(F.col("n") > 1024, F.ceil(F.log2(F.col("n") / 1024.0) / _DIGIT)).otherwise(F.lit(0)).cast("int")
    plan = plan.withColumn("whole", whole).withColumn("depth", depth)
    plan = plan.withColumn("gap", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    plan = staged(plan, "mix-plan")
    for level in range(plan.agg(F.max("depth")).first()[0] or 0):
        plan = staged(_descend(sizes, plan, level), "mix-plan")
    return sizes, staged(_fill(sizes, plan), "mix-plan")


def _with_plan(rows: DataFrame, plan: DataFrame, *columns: str) -> DataFrame:
    small = bounded_broadcast(plan.select(F.col("source").alias("_plan_source"), *columns), MAX_BROADCAST)
    return rows.join(small, F.col("source").eqNullSafe(F.col("_plan_source"))).drop("_plan_source")


def _descend(sizes: DataFrame, plan: DataFrame, level: int) -> DataFrame:
    """The plan with one more digit in the prefix of sources that need it."""
    inside = _with_plan(sizes, plan.filter(F.col("depth") > level), "prefix").filter(_prefix(F.col("place"), F.lit(level)) == F.col("prefix"))
    digit = F.pmod(_prefix(F.col("place"), F.lit(level + 1)), F.lit(1 << _DIGIT))
    sums = inside.groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("words"))
    # 1,024 rows of a source at most
    sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)))
    gap = plan.select(F.col("source").alias("_gap_source"), "gap")
    ends = sums.join(gap, F.col("source").eqNullSafe(F.col("_gap_source"))).filter(F.col("upto") - F.col("words") <= F.col("gap"))
    last = ends.groupBy("source").agg(F.max_by(F.struct("digit", (F.col("upto") - F.col("words")).alias("before")), "digit").alias("at"))
    found = last.select(F.col("source").alias("_at_source"), "at")
    out = plan.join(found, F.col("source").eqNullSafe(F.col("_at_source")), "left").drop("_at_source")
    moved = F.col("at").isNotNull()
    return out.withColumn("gap", F.when(moved, F.col("gap") - F.col("at.before")).otherwise(F.col("gap"))).withColumn("prefix", F.when(moved, F.col("prefix") * (1 << _DIGIT) + F.col("at.digit")).otherwise(F.col("prefix"))).drop("at")


def _fill(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with the ids that are taken inside each source's last group."""
    inside = _with_plan(sizes.filter("size > 0"), plan.filter("gap > 0"), "prefix", "depth").filter(_prefix(F.col("place"), F.col("depth")) == F.col("prefix"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    ids = inside.groupBy("source", "place", key.alias("key")).agg(F.sum("size").alias("size"))
    group = ids.groupBy(F.col("source").alias("_group_source")).agg(F.sort_array(F.collect_list(F.struct("place", "key", "size"))).alias("group"))
    start = F.struct(F.col("gap").alias("gap"), F.array().cast("array<string>").alias("keys"))
    fits = F.aggregate("group", start, lambda a, x: F.when(x["size"] <= a["gap"], F.struct((a["gap"] - x["size"]).alias("gap"), F.concat(a["keys"], F.array(x["key"])).alias("keys"))).otherwise(a))

    def nearest(a: Column) -> Column:
        over = F.array_min(F.transform(F.filter("group", lambda x: ~F.array_contains(a["keys"], x["key"])), lambda x: F.struct((x["size"] - a["gap"]).alias("over"), x["key"].alias("key"))))
        return let(over, lambda o: F.when(o["over"] < a["gap"], F.concat(a["keys"], F.array(o["key"]))).otherwise(a["keys"]))

    out = plan.join(group, F.col("source").eqNullSafe(F.col("_group_source")), "left").withColumn("chosen", F.when(F.col("group").isNull(), F.array().cast("array<string>")).otherwise(let(fits, nearest)))
    return out.drop("_group_source", "group")


def _copies(doc_id: Column, place: Column, p: str = "") -> Column:
    """How often a document is taken; the plan's columns begin with ``p``."""
    at = _prefix(place, F.col(p + "depth"))
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    chosen = (at == F.col(p + "prefix")) & F.array_contains(p + "chosen", key)
    more = (F.col(p + "gap") > 0) & ((at < F.col(p + "prefix")) | chosen)
    return F.col(p + "whole") + F.when(more, F.lit(1)).otherwise(F.lit(0))


def mix_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, weights: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words)."""
    sizes, plan = plan_mix(docs, doc_id, text, source, share, epochs, seed, weights)
    rows = _with_plan(sizes, plan, "source_size", "target", "whole", "gap", "depth", "prefix", "chosen")
    copies = _copies(F.col("doc_id"), F.col("place"))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, weights: DataFrame | None = None) -> DataFrame:
    """The mix itself: every document as many times as it is taken, columns as in ``docs``."""
    _, plan = plan_mix(docs, doc_id, text, source, share, epochs, seed, weights)
    small = plan.select([F.col(c).alias("_mix_" + c) for c in ("source", "whole", "gap", "depth", "prefix", "chosen")])
    # packed, so no column of theirs meets a working column
    packed = docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_source"), F.struct(*docs.columns).alias("_row"))
    rows = packed.join(bounded_broadcast(small, MAX_BROADCAST), F.col("_source").eqNullSafe(F.col("_mix_source")))
    copies = _copies(F.col("_id"), _place(F.col("_id"), seed), "_mix_").cast("int")
    return rows.select("_row", F.explode(F.array_repeat(F.lit(0), copies))).select("_row.*")
