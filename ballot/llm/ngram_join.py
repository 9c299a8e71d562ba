"""N-gram Jaccard join by prefix trees (operator 11).

A document is the set of its distinct word n-grams (64-bit fingerprints).
Documents with equal sets form a class, and only classes go on.

1. Global order: n-grams are ordered by how many documents hold their bucket
   (``buckets`` counts, added up over all documents), rare ones first, then by
   fingerprint.  Every set is a path of a trie in that order.
2. Two linked sets have their first common n-gram within the first
   n - ceil(s n) + 1 places of each, so those places are the trie's doors: only
   classes that share one can meet, and with the places i and j of the first
   common n-gram, min(n - i, m - j) bounds the intersection.
3. Traversal.  A query set walks the trie of the sets that it can meet.  The trie
   is their paths in lexicographic order: a set shares the part it has in
   common with its predecessor, and so the overlap counted up to there, and
   only what lies beyond is compared.  Once a path has more n-grams outside the
   query, or has passed more of the query's, than the remaining lengths allow
   any linked set, the whole subtree below it is skipped.  Links are exact.

No pairs within a door's group are listed.  First every class is a leaf of the
trie that its doors' hubs walk: the hub of a door is the class there that shares
most doors with others, so the text that others were copied from.  The links
found give components.  Doors whose classes all lie in one component are
settled; in the others classes outside the largest component walk the trie of
the classes of other components that the length bound admits.  Before texts are
read again, pairs that share fewer doors than any linked pair are left out.  So a large group
of copies costs a row a member, and no link between two components is lost.

A hub's trie is split by salt into parts of about ``PART`` leaves.  A task reads
the paths as a sorted stream and holds one query and one path.  The driver gets
the ``buckets`` counts, and nothing that grows with the documents.

Defined results: texts of fewer words than an n-gram are one n-gram as a whole;
null and empty texts link with nothing, not even with each other; rows with a
null id link with nothing and have a null component; repeated rows of an id are
judged each, an id with two texts ties both together only if they link; an empty
table gives an empty result.  Other columns are not read.  Ids are cast to long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballot.functions import bounded_broadcast
from ballot.llm import words as W
from ballot.llm.graph import merged, staged

#: Counts behind the global order.
BUCKETS = 1 << 18
#: Leaves of a part of a hub's trie.
PART = 256
#: Ids of texts to read again that are sent to all tasks; beyond it they are shuffled.
MAX_BROADCAST = 500_000


def least_overlap(n: int, num: int, den: int) -> int:
    """Least intersection of a set of n with a linked set."""
    return -(-num * n // den)


def _sets(texts: pa.Array, size: int):
    """(row, sorted distinct n-grams) of every text with words."""
    data, off = W.utf8(texts)
    for a, b in W.slices(len(texts), off, 1 << 20):
        part = data[off[a] : off[b]]
        starts, ends, first = W.word_bounds(part, off[a : b + 1] - off[a])
        h = W.word_hashes(part, starts, ends)
        for i in range(b - a):
            if first[i + 1] > first[i]:
                yield a + i, np.unique(W.shingles(h[first[i] : first[i + 1]], size))


def _class(s: np.ndarray) -> int:
    """The fingerprint of a set."""
    parts = np.array([W.mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(W.mix(s * W._K3)), len(s)], np.uint64)
    return int(W.mix(W.mix(parts) * np.array([W._K1, W._K2, W._K3])).sum(dtype=np.uint64).view(np.int64))


def bucket_counts(docs: DataFrame, text: str, size: int, buckets: int) -> np.ndarray:
    """How many documents hold an n-gram of each bucket, n-grams counted each."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, s in _sets(batch.column(0), size):
                np.add.at(total, (s % np.uint64(buckets)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["b", "c"])

    got = docs.select(text).mapInArrow(count, "b int, c long").groupBy("b").agg(F.sum("c").alias("c")).toArrow()
    total = np.zeros(buckets, np.int64)
    total[got.column("b").to_numpy()] = got.column("c").to_numpy()
    return total


class Order:
    """The global order of n-grams."""

    def __init__(self, counts: np.ndarray):
        # ranks of the counts, so the tasks get four bytes a bucket
        self.rank = np.unique(counts, return_inverse=True)[1].astype(np.int32)

    def path(self, s: np.ndarray) -> np.ndarray:
        """A sorted set in global order."""
        return s[np.argsort(self.rank[(s % np.uint64(len(self.rank))).astype(np.int64)], kind="stable")]


def _signed(docs: DataFrame, doc_id: str, text: str, size: int, num: int, den: int, order: Order) -> DataFrame:
    """doc_id, n, node and doors: the leading n-grams of each document's path."""

    def run(batches):
        for batch in batches:
            n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            doors = [np.zeros(0, np.int32)] * batch.num_rows
            for i, s in _sets(batch.column(1), size):
                n[i], node[i] = len(s), _class(s)
                lead = order.path(s)[: len(s) - least_overlap(len(s), num, den) + 1]
                doors[i] = (lead >> np.uint64(32)).astype(np.uint32).view(np.int32)
            offsets = np.append(0, np.cumsum([len(d) for d in doors])).astype(np.int32)
            flat = np.concatenate(doors) if doors else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(node), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "n", "node", "doors"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "doc_id long, n long, node long, doors array<int>")


def _paths(nodes: DataFrame, need: DataFrame, docs: DataFrame, doc_id: str, text: str, size: int, order: Order) -> DataFrame:
    """(node, path) of the classes in ``need``, from their texts read again."""
    want = staged(nodes.join(need, "node").select(F.col("rep").alias("_id"), F.col("node").alias("_node")), "join-need")
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    rows = rows.join(bounded_broadcast(want, MAX_BROADCAST), "_id").select("_node", "_text")

    def run(batches):
        for batch in batches:
            node, at, found = batch.column(0).to_numpy(), [], []
            for i, s in _sets(batch.column(1), size):
                if _class(s) == node[i]:  # an id may have another text as well
                    at.append(i)
                    found.append(order.path(s))
            offsets = np.append(0, np.cumsum([len(s) for s in found])).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))], names=["node", "path"])

    return rows.mapInArrow(run, "node long, path array<long>").groupBy("node").agg(F.first("path").alias("path"))


class Walk:
    """A query set's walk through a trie whose paths come in lexicographic order."""

    def __init__(self, query: np.ndarray, num: int, den: int):
        self.num, self.den, self.n = num, den, len(query)
        self.sorted = np.sort(query)
        self.place = np.argsort(query, kind="stable")
        self.shortest, self.longest = least_overlap(self.n, num, den), self.n * den // num
        # most n-grams of the path outside the query, and of the query outside the path, of any linked set
        self.outside = self.longest - self._need(self.longest)
        self.passed = self.n - self._need(self.shortest)
        self.path = np.zeros(0, np.int64)
        self.overlap, self.last, self.known, self.dead = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, None

    def _need(self, m: int) -> int:
        return -(-self.num * (self.n + m) // (self.num + self.den))

    def links(self, path: np.ndarray) -> bool:
        """Whether the next path's set is linked with the query."""
        m = min(len(path), len(self.path))
        differ = np.flatnonzero(path[:m] != self.path[:m])
        shared = int(differ[0]) if len(differ) else m
        if self.dead is not None and shared >= self.dead:
            return False
        if not self.shortest <= len(path) <= self.longest:
            return False  # the subtree may hold sets of other lengths
        at = min(shared, self.known)
        overlap, last = np.zeros(len(path) + 1, np.int64), np.zeros(len(path) + 1, np.int64)
        overlap[: at + 1], last[: at + 1] = self.overlap[: at + 1], self.last[: at + 1]
        self.path, self.overlap, self.last, self.dead = path, overlap, last, None
        step = 64
        while at < len(path):
            to = min(at + step, len(path))
            where = np.minimum(np.searchsorted(self.sorted, path[at:to]), self.n - 1)
            hit = self.sorted[where] == path[at:to]
            overlap[at + 1 : to + 1] = overlap[at] + np.cumsum(hit)
            last[at + 1 : to + 1] = np.maximum.accumulate(np.maximum(np.where(hit, self.place[where] + 1, 0), last[at]))
            at, step = to, 2 * step
            if at - overlap[at] > self.outside or last[at] - overlap[at] > self.passed:
                self.known = self.dead = at
                return False
        self.known = at
        both = int(overlap[at])
        return self.den * both >= self.num * (self.n + len(path) - both)


def _sharing(pairs: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """The ``pairs`` (a, b) that share as many doors as a linked pair must.

    Of the set whose last door comes first, all n-grams but n - need lie in the
    other set, need being the least intersection, so at least need - t + 1 of
    its n - t + 1 doors do, and they are doors there as well.
    """
    here, there = (members.select("door", F.col("node").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
    both = pairs.join(here, "a").join(there, ["b", "door"]).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("doors"))
    need = F.ceil((F.col("na") + F.col("nb")) * num / (num + den) - 1e-6)
    most = F.ceil(F.greatest("na", "nb") * num / den + 1e-6)
    return staged(both.filter(F.col("doors") >= need - most + 1).select("a", "b"), "join-sharing")


def _walked(pairs: DataFrame, paths: DataFrame, num: int, den: int) -> DataFrame:
    """The linked ones of ``pairs`` (a, b): every a walks the trie of its b."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).alias("_parts"))
    leaves = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "_parts").cast("int").alias("part"), "b")
    path = paths.select(F.col("node").alias("b"), "path")
    walkers = leaves.select("a", "part").distinct().withColumn("b", F.col("a"))
    rows = leaves.withColumn("leaf", F.lit(1)).unionByName(walkers.withColumn("leaf", F.lit(0))).join(path, "b")
    rows = rows.select("a", "part", "leaf", "b", "path").repartition("a", "part").sortWithinPartitions("a", "part", "leaf", "path")

    def run(batches):
        key = walk = None
        for batch in batches:
            a, part, leaf, b = (batch.column(i).to_numpy() for i in range(4))
            found = []
            offsets, flat = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
            for i in range(batch.num_rows):
                p = flat[offsets[i] : offsets[i + 1]]
                if not leaf[i]:
                    key, walk = (a[i], part[i]), Walk(p, num, den)
                elif (a[i], part[i]) == key and walk.links(p):
                    found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(b[found])], names=["a", "b"])

    return staged(rows.mapInArrow(run, "a long, b long"), "join-links")


def _admitted(num: int, den: int) -> Column:
    """Whether x and y may be linked, by their sizes n and the places i of a first common door."""
    sizes = F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num
    left = F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i"))
    return sizes & (left * (num + den) >= (F.col("x.n") + F.col("y.n")) * num)


def linked_classes(nodes: DataFrame, members: DataFrame, paths_of, num: int, den: int) -> DataFrame | None:
    """(node, comp) of the linked classes, None without links.  ``members``: (door, i, node, n)."""
    # the hub of each door meets all others there
    shared = members.groupBy("node").agg(F.count(F.lit(1)).alias("_k"))
    hubs = members.join(shared, "node").groupBy("door").agg(F.max_by(F.struct("node", "n", "i"), F.struct("_k", "node")).alias("h"))
    met = members.alias("x").join(hubs.select("door", "h.*").alias("y"), "door").filter(F.col("x.node") != F.col("y.node"))
    met = met.filter(_admitted(num, den)).select(F.col("y.node").alias("a"), F.col("x.node").alias("b"))
    pairs = staged(met.distinct(), "join-hubs")
    near = _sharing(pairs, members, num, den)
    links = _walked(near, paths_of(near), num, den)
    comp = merged(None, links) if links.limit(1).count() else None

    # doors that hold several components
    if comp is None:
        placed = members.withColumn("comp", F.col("node"))
    else:
        placed = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    each = placed.groupBy("door", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = each.groupBy("door").agg(F.count(F.lit(1)).alias("_comps"), F.max_by("comp", F.struct("c", "comp")).alias("main")).filter("_comps > 1")
    open_ = staged(placed.join(main, "door").select("door", "i", "node", "n", "comp", "main"), "join-open")
    x, y = open_.filter("comp <> main").alias("x"), open_.alias("y")
    apart = (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    rest = x.join(y, (F.col("x.door") == F.col("y.door")) & apart & _admitted(num, den))
    rest = rest.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    done = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = staged(rest.join(done, ["a", "b"], "left_anti"), "join-rest")
    if not rest.limit(1).count():
        return comp
    rest = _sharing(rest, members, num, den)
    more = _walked(rest, paths_of(rest), num, den)
    if not more.limit(1).count():
        return comp
    return merged(comp, more)


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, num: int = 85, den: int = 100, buckets: int = BUCKETS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id.

    Links have den * |intersection| >= num * |union|; component_id is the
    smallest id that is reachable by links.
    """
    order = Order(bucket_counts(docs, text, size, buckets))
    signed = staged(_signed(docs, doc_id, text, size, num, den, order), "join-signed")
    real = signed.filter("n > 0 and doc_id is not null")
    nodes = staged(real.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("doors").alias("doors")), "join-nodes")
    placed = nodes.select("node", "n", F.posexplode("doors").alias("i", "door"))
    shared = placed.groupBy("door").count().filter("count > 1").select("door")
    members = staged(placed.join(shared, "door").select("door", "i", "node", "n"), "join-members")

    def paths_of(pairs: DataFrame) -> DataFrame:
        need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        return _paths(nodes.select("node", "rep"), need, docs, doc_id, text, size, order)

    comp = linked_classes(nodes, members, paths_of, num, den)
    label = nodes.select("node", F.col("rep").alias("_label"))
    if comp is not None:
        reps = comp.join(nodes.select("node", "rep"), "node")
        least = reps.groupBy("comp").agg(F.min("rep").alias("_least"))
        label = label.join(reps.join(least, "comp").select("node", "_least"), "node", "left").select("node", F.coalesce("_least", "_label").alias("_label"))
    out = signed.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(label, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_label", "doc_id").alias("component_id"))
