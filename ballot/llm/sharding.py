"""Sharding (operator 6): a permutation-filled lookup table.

Every shard orders all slots of a prime-sized table by its own permutation
(an offset and a stride, both hashed from the shard's name).  The shards take
turns; on its turn a shard claims the first slot of its order that is free.
After the last claim each shard holds table_size / shards slots, give or take
one, and leaving out a shard moves few slots besides its own.  A row's slot
is its key's hash modulo the table size, so placing a row is one lookup in a
broadcast table of ``table_size`` rows, whatever the number of rows.

Defined results: a null key is hashed as the empty string; equal keys share a
shard; an empty table gives an empty result; no other column is looked at.
The columns ``slot`` and ``shard`` are replaced if the input has them.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime; the table is broadcast, so this is its proven bound in rows.
TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], table_size: int = TABLE_SIZE) -> np.ndarray:
    """The number of the shard that owns each slot."""
    if not _is_prime(table_size):
        raise ValueError(f"table_size must be prime: {table_size}")
    if not 0 < len(shards) <= table_size or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, at least one and at most table_size")
    digests = [hashlib.md5(s.encode()).digest() for s in shards]
    offset = [int.from_bytes(d[:8], "big") % table_size for d in digests]
    stride = [int.from_bytes(d[8:], "big") % (table_size - 1) + 1 if table_size > 2 else 1 for d in digests]
    owner = np.full(table_size, -1, np.int32)
    at, claimed = list(offset), 0
    while True:
        for i in range(len(shards)):
            slot = at[i]
            while owner[slot] >= 0:
                slot = (slot + stride[i]) % table_size
            owner[slot] = i
            at[i] = (slot + stride[i]) % table_size
            claimed += 1
            if claimed == table_size:
                return owner


def slot_of(key: Column, table_size: int = TABLE_SIZE) -> Column:
    """md5 of the key as text, its first 15 hex digits modulo the table size."""
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(table_size)).cast("int")


def table_frame(spark: SparkSession, shards: list[str], table_size: int = TABLE_SIZE) -> DataFrame:
    owner = lookup_table(shards, table_size)
    return spark.createDataFrame([(i, shards[k]) for i, k in enumerate(owner.tolist())], "slot int, shard string")


def assign_shards(df: DataFrame, key: str, shards: list[str], table_size: int = TABLE_SIZE) -> DataFrame:
    """The rows of ``df`` with their ``slot`` and ``shard``; no shuffle."""
    table = F.broadcast(table_frame(df.sparkSession, shards, table_size))
    placed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), table_size))
    return placed.join(table, "slot").select(*[c for c in placed.columns if c != "slot"], "slot", "shard")


def write_shards(df: DataFrame, path: str, key: str, shards: list[str], files_per_shard: int = 4, table_size: int = TABLE_SIZE) -> None:
    """One folder per shard.  Rows of a shard are dealt over ``files_per_shard``
    tasks by a hash of the whole row, so a shard with a hot key is split too."""
    placed = assign_shards(df, key, shards, table_size)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in placed.columns]), F.lit(files_per_shard))
    placed.repartition(F.col("shard"), salt).write.partitionBy("shard").parquet(path)
