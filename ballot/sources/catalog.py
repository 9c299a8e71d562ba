"""A catalogue of stage files, so that a pipeline reruns only what changed.

Every stage has a key: the hash of its name, its parameters and the keys of its
inputs.  The key of a file source is the hash of its files' paths, lengths and
modification times, read with Spark's file listing (no file is opened).  A
stage whose key is in the manifest is read from its folder; any other is
computed, written to a folder of its own and then added to the manifest, so
a stage cut off half-way is never taken for a whole one.  ``clean`` removes
the folders of stages that this run did not use.

The manifest is one row a stage, whatever the data; it is all the driver reads.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballot.session import freed_shuffles, remove_path

_MANIFEST = "n long, name string, key string, path string, inputs array<string>, params string"

#: Characters that Spark leaves as they are in the folder of a partition, besides letters and digits.
_PLAIN = "_-.~ !$&(),;@+|<>"


@dataclass(frozen=True)
class Stage:
    """A source or a stage: its name, its key, and its rows."""

    name: str
    key: str
    frame: DataFrame | None = None


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:20]


class StageCatalog:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        try:
            rows = spark.read.schema(_MANIFEST).json(f"{self.base}/_manifest").collect()
        except AnalysisException:  # the first run has no manifest
            rows = []
        self.manifest = {(r["name"], r["key"]): r.asDict() for r in sorted(rows, key=lambda r: r["n"])}
        self.used: set[tuple[str, str]] = set()
        self.written: list[str] = []
        self.reused: list[str] = []

    def sources(self, paths: Mapping[str, str]) -> dict[str, Stage]:
        """A source for each named path, keyed by its files."""
        if not paths:
            return {}
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths.values()))
        plain = lambda p: re.sub(r"^[A-Za-z]+:/+", "/", p).rstrip("/")
        at = F.concat(F.regexp_replace("path", r"^[A-Za-z]+:/+", "/"), F.lit("/"))
        name = F.coalesce(*(F.when(at.contains(plain(p) + "/"), F.lit(n)) for n, p in sorted(paths.items(), key=lambda x: -len(x[1]))))
        mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
        rows = files.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum(mark).cast("string").alias("mark")).collect()
        found = {r["name"]: (r["n"], r["mark"]) for r in rows}
        return {n: Stage(n, _digest("files", plain(p), found.get(n))) for n, p in paths.items()}

    def stage(self, name: str, build: Callable[[], DataFrame], inputs: Sequence[Stage] = (), params: Mapping | None = None) -> Stage:
        """The stage ``name`` of these inputs and parameters, computed only if it is not there."""
        row = self._row(name, inputs, params)
        if not self._known(row):
            row["path"] = f"{self.base}/{name}/{row['key']}"
            out = build()
            with freed_shuffles(self.spark):
                out.write.mode("overwrite").parquet(row["path"])
            self._add([row])
        return self._stage(name, row["key"])

    def parts(self, column: str, wanted: Mapping[str, tuple[str, Stage, Mapping]], build: Callable[[list[str]], DataFrame]) -> dict[str, Stage]:
        """Stages that differ in the value of ``column`` alone: value -> (name,
        input, parameters).  Those that are not there are computed by one job,
        ``build`` of their values, and written to a folder each."""
        rows = {v: self._row(name, [given], params) for v, (name, given, params) in wanted.items()}
        missing = [v for v in rows if not self._known(rows[v])]
        if missing:
            base = f"{self.base}/_parts/{_digest([rows[v]['key'] for v in missing])}"
            out = build(missing)
            with freed_shuffles(self.spark):
                out.write.mode("overwrite").partitionBy(column).parquet(base)
            for v in missing:
                rows[v]["path"] = f"{base}/{column}={quote(v, safe=_PLAIN)}"
            self._add([rows[v] for v in missing])
        return {v: self._stage(row["name"], row["key"]) for v, row in rows.items()}

    def _row(self, name: str, inputs: Sequence[Stage], params: Mapping | None) -> dict:
        keys, params = [i.key for i in inputs], json.dumps(dict(params or {}), sort_keys=True)
        return {"n": None, "name": name, "key": _digest(name, params, keys), "path": None, "inputs": keys, "params": params}

    def _known(self, row: dict) -> bool:
        found = (row["name"], row["key"]) in self.manifest
        (self.reused if found else self.written).append(row["name"])
        return found

    def _add(self, rows: list[dict]) -> None:
        first = 1 + max((row["n"] for row in self.manifest.values()), default=-1)
        rows = [row | {"n": first + i} for i, row in enumerate(rows)]
        self._rows(rows).write.mode("append").json(f"{self.base}/_manifest")
        self.manifest |= {(row["name"], row["key"]): row for row in rows}

    def _stage(self, name: str, key: str) -> Stage:
        self.used.add((name, key))
        return Stage(name, key, self.spark.read.parquet(self.manifest[name, key]["path"]))

    def latest(self, name: str) -> Stage:
        """The stage of that name written last, by an earlier run or by this one."""
        found = [key for n, key in self.manifest if n == name]
        if not found:
            raise ValueError(f"no stage {name!r} in {self.base}")
        return self._stage(name, found[-1])

    def clean(self) -> list[str]:
        """Remove the stages that this run did not use; their names."""
        gone = [x for x in self.manifest if x not in self.used]
        if gone:
            kept = [row for x, row in self.manifest.items() if x in self.used]
            # first out of the manifest, so no run takes a folder that is about to go
            self._rows(kept).write.mode("overwrite").json(f"{self.base}/_manifest")
            for x in gone:
                remove_path(self.spark, self.manifest.pop(x)["path"])
        return [name for name, _ in gone]

    def _rows(self, rows: list[dict]) -> DataFrame:
        return self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
