"""Sharding by a permutation-filled lookup table.

Shards take turns; in its turn each claims the next free slot in its own order of preference, a walk
of the prime-sized table by a fixed stride. Every shard ends up with the same number of slots, give
or take one, and adding or removing a shard moves few others. A document's key is hashed to a slot,
and the broadcast table names its shard.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int) -> list[int]:
    """Slot → position in ``shards``. ``size`` is a prime of at least the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime not below the number of shards")
    table = [-1] * size
    at = [_digest(f"offset:{name}") % size for name in shards]
    stride = [_digest(f"stride:{name}") % (size - 1) + 1 if size > 2 else 1 for name in shards]
    for turn in range(size):
        k = turn % len(shards)
        while table[at[k]] >= 0:
            at[k] = (at[k] + stride[k]) % size
        table[at[k]] = k
    return table


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key: 12 hexadecimal digits of its digest, modulo the table's size. A null key is the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(size)).cast("int")


def lookup_table(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """(slot, shard): ``size`` rows, whatever the data."""
    names = F.array(*[F.lit(s) for s in shards])
    filled = F.posexplode(F.lit(fill_table(shards, size))).alias("slot", "place")
    return spark.range(1).select(filled).select("slot", F.element_at(names, F.col("place") + 1).alias("shard"))


def assign_shards(docs: DataFrame, shards: list[str], size: int = 4093, key_col: str = "doc_id", slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """docs with their slot and shard; no row moves.

    Rows with the same key, repeated rows too, share a shard; null keys are placed as the empty text;
    an empty table stays empty. Columns of docs named as the two new ones are replaced.
    """
    table = lookup_table(docs.sparkSession, shards, size).toDF("__slot", "__shard")
    placed = docs.withColumn("__at", slot_of(F.col(key_col), size)).join(F.broadcast(table), F.col("__at") == F.col("__slot"))
    kept = [c for c in docs.columns if c not in (slot_col, shard_col)]
    return placed.select(*kept, F.col("__at").alias(slot_col), F.col("__shard").alias(shard_col))
