"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table.
Shards take turns; at each turn a shard claims the first slot of its
permutation that is still free. The filled table maps slot -> shard, every
shard owns as many slots as any other (one more at most), and adding or
removing a shard moves few slots between the others.

The table has a fixed size that does not depend on the data, so it is
broadcast; placing a row is one hash and one lookup, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import hex60

#: Prime number of slots; a table of this size is about 0.5 MB when broadcast.
TABLE_SIZE = 65537
#: Largest table that is broadcast without asking.
MAX_TABLE_SIZE = 1 << 22


def _seed(name: str, salt: str, modulus: int) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big") % modulus


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """slot -> index into ``shards``. Cost depends on ``size`` alone."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not _is_prime(size) or size < len(shards) or size > MAX_TABLE_SIZE:
        raise ValueError(f"size must be a prime from the number of shards to {MAX_TABLE_SIZE}")
    at = [_seed(name, "offset", size) for name in shards]
    step = [_seed(name, "skip", size - 1) + 1 if size > 2 else 1 for name in shards]
    table, left = [-1] * size, size
    while left:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    return F.pmod(hex60(key), F.lit(size)).cast("int")


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot int, shard string), one row a slot, from one literal."""
    owners = ",".join(map(str, fill_table(shards, size)))
    names = F.split(F.lit("\n".join(shards)), "\n")
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "k")).select("slot", F.get(names, F.col("k").cast("int")).alias("shard"))


def assign_shards(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard``, which replace columns of those names.

    Rows with equal keys share a shard; a null key is placed as the empty
    string. An empty table gives an empty result of the same columns. No row is
    moved: the lookup is a broadcast join of ``size`` rows.
    """
    if any("\n" in name for name in shards):
        raise ValueError("a shard's name cannot hold a line break")
    own = "__brindle_slot"
    table = lookup_table(df.sparkSession, shards, size).select(F.col("slot").alias("__brindle_at"), F.col("shard").alias("__brindle_shard"))
    placed = df.withColumn(own, slot_of(F.col(key), size)).join(F.broadcast(table), F.col(own) == F.col("__brindle_at"))
    kept = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    return placed.select(*(F.col(f"`{c}`") for c in kept), F.col(own).alias("slot"), F.col("__brindle_shard").alias("shard"))
