"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``.  All stages but the last return the columns of
``documents``.  A stage works on all rows that its predecessor kept.

Defined results: null texts fail the quality rules; a null id is kept by
near-dedup (nothing identifies it); columns besides those that a stage reads
are carried along; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ballot.llm import decontaminate, mixing, neardup, quality, sharding
from ballot.llm import queries as Q
from ballot.session import scratch_path

#: Near copies: five-word shingles, a Jaccard similarity of 0.8 or more.
NEAR = {"shingle": 5, "num": 80, "den": 100, "rows": 7, "bands": 56}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules."""
    return quality.keep_good(docs, Q.trusted(spark, sf_dir), labels=Q.labels(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    return neardup.keep_first(docs, **NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.drop_leaking(docs, Q.benchmark(spark, sf_dir))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their slot and shard."""
    return sharding.assign_shards(docs, "doc_id", Q.SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shard),
]

#: SQL expresses neither MinHash links nor SimHash windows; tests/llm compares
#: the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
