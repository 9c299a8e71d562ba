"""Line dedup (operator 4): levelled sorted runs of line hashes.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower
cased.  Keys of at least ``min_chars`` code points that several documents hold
stay only in the smallest document id that holds them.

The documents are taken in batches of ascending ids.  Keys seen so far lie in
runs: Parquet folders of (key, owner), range-partitioned and sorted by key.  A
new batch looks its keys up in all runs (merge joins on the key), then
appends those it found in none as a run of level 0.  When a level holds
``fanout`` runs they are merged into one run of the next level, so a batch
meets at most ``fanout`` - 1 runs of each of about log(batches) levels.  Runs lie in the
shared checkpoint folder, so a lost executor costs only its running tasks.
As ids ascend from batch to batch, a key's first run has its smallest holder.

Hot lines: keys are first reduced to one row for each key and document, then
to the smallest id with map-side aggregation; lookups of a hot key are a join
whose large side Spark splits.

Defined results: a null or empty text is one empty line; repeated rows of one
id are the same holder and keep alike; a null id counts as larger than all
others; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballot.llm import words as W
from ballot.session import scratch_path

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
#: Stands for a null id: it holds a line only where no other id does.
NO_ID = 2**63 - 1


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """Per line the digest of its key, or None for a key that is too short."""
    out: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip().lower()  # of bytes: ASCII whitespace and letters only
        short = len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars
        out.append(None if short else hashlib.md5(key).digest())
    return out


def _lines(batches):
    """(doc, k1, k2) of every long enough line, once for each row and key."""
    for batch in batches:
        ids, a, b = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            keys = {k for k in line_keys(text.as_py()) if k is not None}
            ids += [NO_ID if doc is None else doc] * len(keys)
            both = np.frombuffer(b"".join(sorted(keys)), "<i8").reshape(-1, 2)
            a.append(both[:, 0])
            b.append(both[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(a) if a else [], pa.int64()), pa.array(np.concatenate(b) if b else [], pa.int64())], names=["doc", "k1", "k2"])


class Runs:
    """The levels: lists of run paths, newest last."""

    def __init__(self, spark: SparkSession, fanout: int):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = [[]]

    def paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def read(self) -> list[DataFrame]:
        return [self.spark.read.parquet(p) for p in self.paths()]

    def _write(self, rows: DataFrame) -> str:
        path = scratch_path(self.spark, "line-run")
        rows.sortWithinPartitions("k1", "k2").write.parquet(path)
        return path

    def add(self, rows: DataFrame) -> None:
        """Append a run, then merge every level that is full into the next."""
        self.levels[0].append(self._write(rows))
        for i in range(len(self.levels)):
            if len(self.levels[i]) >= self.fanout:
                # runs hold disjoint keys, so merging is a sort of their union
                merged = self.spark.read.parquet(*self.levels[i])
                path = self._write(merged.repartitionByRange("k1", "k2"))
                self.levels[i] = []
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(path)


def duplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc, k1, k2) of the lines that each document loses."""
    spark = docs.sparkSession
    staged = scratch_path(spark, "lines")
    keys = docs.select(F.col(doc_id).cast("long"), text).mapInArrow(_lines, "doc long, k1 long, k2 long")
    keys.write.parquet(staged)
    lines = spark.read.parquet(staged)
    # where the batches end: this sets their sizes, not the result
    places = [i / batches for i in range(1, batches)]
    cuts = sorted({int(c) for c in lines.filter(F.col("doc") != NO_ID).approxQuantile("doc", places, 0.001)} if places else ())
    runs, losses = Runs(spark, fanout), None
    for low, high in zip([None, *cuts], [*cuts, None]):
        batch = lines
        if low is not None:
            batch = batch.filter(F.col("doc") > low)
        if high is not None:
            batch = batch.filter(F.col("doc") <= high)
        held = batch.groupBy("k1", "k2").agg(F.min("doc").alias("own"))
        for run in runs.read():
            held = held.join(run.withColumnRenamed("owner", "_seen"), ["k1", "k2"], "left").withColumn("own", F.least("own", "_seen")).drop("_seen")
        # a key's owner in this batch, its holder in an earlier one if it has any
        found = scratch_path(spark, "line-owners")
        held.write.parquet(found)
        owners = spark.read.parquet(found)
        lost = batch.join(owners, ["k1", "k2"]).filter(F.col("own") < F.col("doc")).select("doc", "k1", "k2")
        losses = lost if losses is None else losses.unionByName(lost)
        if high is not None:
            new = owners if low is None else owners.filter(F.col("own") > low)
            runs.add(new.select("k1", "k2", F.col("own").alias("owner")))
    return losses


def _cut(text: str | None, lost: set[bytes]) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    kept = [x for x, k in zip(lines, line_keys(text)) if k not in lost]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def _apply(batches):
    for batch in batches:
        n, gone, kept = [], [], []
        for text, lost in zip(batch.column("_text"), batch.column("_lost")):
            t, raw = text.as_py(), lost.as_py() or b""
            x = _cut(t, {raw[i : i + 16] for i in range(0, len(raw), 16)})
            n.append(x[0])
            gone.append(x[1])
            kept.append(x[2])
        yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])


def _join_keys(batches):
    """Many (doc, k1, k2) rows of a document -> one binary of 16-byte keys for a batch."""
    for batch in batches:
        d, both = batch.column(0).to_numpy(), np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], 1).astype("<i8")
        order = np.argsort(d, kind="stable")
        ids, first = np.unique(d[order], return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x.tobytes() for x in np.split(both[order], first[1:])] if len(ids) else [], pa.binary())], names=["_doc", "_part"])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept (the text that stays)."""
    lost = duplicate_lines(docs, doc_id, text, batches, fanout)
    parts = lost.mapInArrow(_join_keys, "_doc long, _part binary")
    # one document's lost keys: no more than its own lines
    per_doc = parts.groupBy("_doc").agg(F.collect_list("_part").alias("_parts")).select("_doc", F.expr("aggregate(_parts, cast('' as binary), (a, b) -> concat(a, b))").alias("_lost"))
    rows = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).alias("_text"))
    joined = rows.withColumn("_key", F.coalesce("_doc", F.lit(NO_ID))).join(per_doc.withColumnRenamed("_doc", "_key"), "_key", "left")
    return joined.select("_doc", "_text", "_lost").mapInArrow(_apply, "doc_id long, n_lines long, n_dropped long, kept string")
