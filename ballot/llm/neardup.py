"""MinHash near-dedup with odd sketches (operator 10).

A document is the set of its distinct word shingles (64-bit fingerprints).
Documents with equal sets form a class, and only classes go on.

1. Every class gets ``rows`` x ``bands`` MinHash samples.  A band is the hash
   of ``rows`` samples; classes that share a band are candidates.  At the
   threshold s a pair shares no band with a chance of (1 - s**rows)**bands:
   2e-7 for 8 x 48 at 0.85, 2e-6 for 7 x 56 at 0.8.
2. The samples are folded into an odd sketch: sample i with value v flips one
   of 512 bits.  Samples that two sets have in common cancel out in the XOR of
   their sketches, so its population count measures how many differ, most
   precisely for high similarities.  Candidates whose count is beyond what the
   threshold allows (by 4.5 standard deviations of the MinHash estimate and
   the sketch's own noise together) are dropped.  So are those whose full
   sets' parity bitmaps differ in more bits than linked sets differ in
   elements; equal elements cancel out, so this drops no link.
3. The others are confirmed on their full sets.

Candidates are not all pairs of a band's classes.  In rounds, each class is
paired with one hub of each of its bands: the class that shares most bands
with others, so the text that the others were copied from.  Confirmed links
give components; a band whose classes all lie in one component is settled, as
no pair in it can change the result.  After ``HUB_ROUNDS`` rounds (fewer if one
finds nothing) the bands that are still open are joined with themselves: each
class outside the band's largest component meets all classes of other
components inside an equi-join on the band, where only pairs that the sketches
let through leave the join, once, in the first band they share; large bands
are split by Spark.  So a large group of copies costs a row a member and
round, and no link between two components is lost.

Defined results: texts of fewer words than a shingle are one shingle as a
whole; null and empty texts link with nothing, not even with each other;
rows with a null id link with nothing, have a null component and are kept;
repeated rows of an id are one document; an empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballot.functions import bounded_broadcast
from ballot.llm import words as W
from ballot.llm.graph import merged, staged

SKETCH_BITS = 512
#: Bits of the parity bitmap of a full set.
PARITY_BITS = 1024
#: Rows of (id, class) that are sent to all tasks at most; beyond it they are shuffled.
MAX_BROADCAST = 1_000_000
HUB_ROUNDS = 1
_S = [f"s{i}" for i in range(SKETCH_BITS // 64)]
_T = [f"t{i}" for i in range(PARITY_BITS // 64)]


def max_odd(threshold: float, samples: int) -> int:
    """Population count up to which a pair may reach the threshold."""
    differ = 2 * samples * (1 - threshold)
    stay = math.exp(-2 * differ / SKETCH_BITS)
    of_samples = 2 * math.sqrt(samples * threshold * (1 - threshold)) * stay
    of_sketch = math.sqrt(SKETCH_BITS * (1 - stay * stay)) / 2
    return math.ceil(SKETCH_BITS / 2 * (1 - stay) + 4.5 * math.hypot(of_samples, of_sketch))


class Signer:
    def __init__(self, rows: int, bands: int, seed: int = 1789):
        rng = np.random.default_rng(seed)
        self.rows, self.bands, k = rows, bands, rows * bands
        self.a = rng.integers(0, 2**31, (k, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, (k, 1), dtype=np.uint32)
        self.salt = W.mix(np.arange(1, k + 1, dtype=np.uint64))

    def samples(self, s: np.ndarray) -> np.ndarray:
        low = (s >> np.uint64(32)).astype(np.uint32)
        best = None
        for at in range(0, len(low), 1024):
            least = (self.a * low[at : at + 1024] + self.b).min(axis=1)
            best = least if best is None else np.minimum(best, least)
        return best.astype(np.uint64)

    def sign(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Band hashes, odd sketch of the samples and parity bitmap of the set."""
        m = self.samples(s)
        acc = np.arange(1, self.bands + 1, dtype=np.uint64)
        for column in m.reshape(self.bands, self.rows).T:
            acc = (acc ^ (acc >> np.uint64(31))) * W._K1 + column
        bit = (W.mix(m ^ self.salt) % np.uint64(SKETCH_BITS)).astype(np.int64)
        whole = (W.mix(s) % np.uint64(PARITY_BITS)).astype(np.int64)
        return W.mix(acc), _parity(bit, SKETCH_BITS), _parity(whole, PARITY_BITS)


def _parity(bit: np.ndarray, size: int) -> np.ndarray:
    return np.packbits((np.bincount(bit, minlength=size) & 1).astype(np.uint8)).view(np.uint64)


def _sets(texts: pa.Array, shingle: int):
    """(row, sorted distinct shingle fingerprints) of every text with words."""
    data, off = W.utf8(texts)
    for a, b in W.slices(len(texts), off, 1 << 20):
        part = data[off[a] : off[b]]
        starts, ends, first = W.word_bounds(part, off[a : b + 1] - off[a])
        h = W.word_hashes(part, starts, ends)
        for i in range(b - a):
            if first[i + 1] > first[i]:
                yield a + i, np.unique(W.shingles(h[first[i] : first[i + 1]], shingle))


def _node(s: np.ndarray) -> np.int64:
    """The fingerprint of a set."""
    parts = np.array([W.mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(W.mix(s * W._K3)), len(s)], np.uint64)
    return W.mix(W.mix(parts) * np.array([W._K1, W._K2, W._K3])).sum(dtype=np.uint64, keepdims=True).view(np.int64)[0]


def signatures(docs: DataFrame, doc_id: str, text: str, shingle: int, rows: int, bands: int) -> DataFrame:
    signer = Signer(rows, bands)

    def run(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            node = np.zeros(batch.num_rows, np.int64)
            band = np.zeros((batch.num_rows, bands), np.uint64)
            odd = np.zeros((batch.num_rows, len(_S) + len(_T)), np.uint64)
            for i, s in _sets(batch.column(1), shingle):
                n[i], node[i] = len(s), _node(s)
                band[i], odd[i, : len(_S)], odd[i, len(_S) :] = signer.sign(s)
            own = np.where(n > 0, bands, 0)
            offsets = np.append(0, np.cumsum(own)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[n > 0].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(node), lists, *[pa.array(odd[:, j].copy().view(np.int64)) for j in range(odd.shape[1])]], names=["doc_id", "n", "node", "bands", *_S, *_T])

    schema = "doc_id long, n long, node long, bands array<long>, " + ", ".join(f"{x} long" for x in (*_S, *_T))
    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, schema)


def _differ(columns: list[str]) -> Column:
    """Bits in which x and y differ."""
    return reduce(add, (F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in columns))


def _close(num: int, den: int, samples: int) -> Column:
    """Pairs x, y whose sizes and sketches allow a link."""
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    # linked sets differ in (|x| + |y|) (den - num) / (den + num) elements at most
    whole = _differ(_T) * (den + num) <= (F.col("x.n") + F.col("y.n")) * (den - num)
    return (small * den >= large * num) & whole & (_differ(_S) <= max_odd(num / den, samples))


def _sets_of(members: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(node, items): the full sets of the classes that share a band."""
    need = nodes.join(members.select("node").distinct(), "node", "left_semi")
    need = staged(need.select(F.col("rep").alias("_id"), F.col("node").alias("_node")), "near-need")
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    rows = rows.join(bounded_broadcast(need, MAX_BROADCAST), "_id").select("_node", "_text")

    def run(batches):
        for batch in batches:
            want, at, found = batch.column(0).to_numpy(), [], []
            for i, s in _sets(batch.column(1), shingle):
                if _node(s) == want[i]:  # an id may have another text as well
                    at.append(i)
                    found.append(s)
            offsets = np.append(0, np.cumsum([len(s) for s in found])).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(want[at]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))], names=["node", "items"])

    return staged(rows.mapInArrow(run, "node long, items array<long>"), "near-sets")


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""
    pairs = staged(pairs, "near-pairs")
    need = staged(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "near-need")
    some = sets.join(bounded_broadcast(need, MAX_BROADCAST), "node").groupBy("node").agg(F.first("items").alias("items"))
    both = pairs.join(some.select(F.col("node").alias("a"), F.col("items").alias("_x")), "a").join(some.select(F.col("node").alias("b"), F.col("items").alias("_y")), "b")
    same = F.size(F.array_intersect("_x", "_y"))
    return staged(both.filter(den * same >= num * (F.size("_x") + F.size("_y") - same)).select("a", "b"), "near-links")


def _links(members: DataFrame, nodes: DataFrame, sets: DataFrame, num: int, den: int, samples: int) -> DataFrame | None:
    """(node, comp) of the linked classes.  ``members``: (band, node)."""
    light = nodes.select("node", "n", *_S, *_T)
    x, y = light.alias("x"), light.alias("y")
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("_c"))
    weights = members.join(sizes, "band").groupBy("node").agg(F.sum("_c").alias("weight"))
    free = F.lit(False).alias("was_hub")
    open_ = staged(members.join(weights, "node").select("band", "node", "weight", F.col("node").alias("comp"), free), "near-open")
    tested, comp = None, None
    for _ in range(HUB_ROUNDS):
        best = F.max_by(F.struct("node", "comp"), F.struct("weight", "node"))
        hubs = open_.filter("not was_hub").groupBy("band").agg(best.alias("hub")).select("band", F.col("hub.node").alias("hub"), F.col("hub.comp").alias("hub_comp"))
        met = staged(open_.join(hubs, "band"), "near-hubs")
        pairs = met.filter("comp <> hub_comp").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = staged(pairs, "near-tested")
        near = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).filter(_close(num, den, samples)).select("a", "b")
        found = _confirm(near, sets, num, den)
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = found.limit(1).count()
        if new:
            comp = merged(comp, found)
        now = met.withColumn("was_hub", F.col("was_hub") | (F.col("node") == F.col("hub"))).drop("hub", "hub_comp")
        if new:
            now = now.drop("comp").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            mixed = now.groupBy("band").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).filter("_a < _b").select("band")
            now = now.join(mixed, "band")
        open_ = staged(now.select("band", "node", "weight", "comp", "was_hub"), "near-open")
        if not new:
            break

    # all pairs of components in the bands that are still open
    counts = open_.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("band").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    rest = staged(open_.select("band", "node", "comp").join(main, "band").join(nodes.select("node", "n", "bands", *_S, *_T), "node"), "near-rest")
    differ = (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    once = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.band")
    pairs = rest.filter("comp <> main").alias("x").join(rest.alias("y"), (F.col("x.band") == F.col("y.band")) & differ & _close(num, den, samples) & once)
    pairs = pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).join(tested, ["a", "b"], "left_anti")
    found = _confirm(pairs, sets, num, den)
    return merged(comp, found) if found.limit(1).count() else comp


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, num: int = 85, den: int = 100, rows: int = 8, bands: int = 48) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Links have den * |intersection| >= num * |union|.
    """
    signed = staged(signatures(docs, doc_id, text, shingle, rows, bands), "near-signed")
    real = signed.filter("n > 0 and doc_id is not null")
    firsts = [F.first(x).alias(x) for x in ("n", "bands", *_S, *_T)]
    nodes = staged(real.groupBy("node").agg(F.min("doc_id").alias("rep"), *firsts), "near-nodes")

    # bands that hold several classes, and their members
    placed = nodes.select(F.explode("bands").alias("band"), "node")
    shared = placed.groupBy("band").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).filter("_a < _b").select("band")
    members = staged(placed.join(shared, "band"), "near-members")
    sets = _sets_of(members, nodes, docs, doc_id, text, shingle)
    comp = _links(members, nodes, sets, num, den, rows * bands)

    final = nodes.select("node", F.col("rep").alias("_label"))
    if comp is not None:
        labels = comp.join(nodes.select("node", "rep"), "node")
        smallest = labels.groupBy("comp").agg(F.min("rep").alias("label"))
        linked = labels.join(smallest, "comp").select("node", "label")
        final = final.join(linked, "node", "left").select("node", F.coalesce("label", "_label").alias("_label"))
    out = signed.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(final, "node", "left")
    label = F.coalesce("_label", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), label.alias("component_id"), F.coalesce(label == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the ids that near_duplicates does not keep.

    Ids that go are sent to all tasks up to ``MAX_BROADCAST``; texts are
    shuffled only beyond it.  An id of which some row is kept stays whole.
    """
    judged = near_duplicates(docs, doc_id, text, **options).filter("doc_id is not null")
    gone = judged.groupBy(F.col("doc_id").alias("_gone")).agg(F.max("kept").alias("_kept")).filter("not _kept").select("_gone")
    gone = bounded_broadcast(staged(gone, "near-gone"), MAX_BROADCAST)
    return docs.alias("d").join(gone.alias("g"), F.col(f"d.{doc_id}") == F.col("g._gone"), "left_anti")
