"""Sharding by a permutation-filled lookup table.

Every shard has an order of preference over the slots of a table of prime size:
an offset and a step, from a digest of the shard's name, walk through all of
them. The shards take turns, each claiming the first free slot in its order, until
none is free. All shards own the same number of slots, to one, and when a shard
joins or leaves few slots change hands. A row's slot is a digest of its key modulo
the size, and the shard is read from the table, which is broadcast: the table
depends on the shards only, has ``SLOTS`` rows at any input size, and rows are
neither shuffled nor counted.

Defined results: equal keys go to the same shard, so repeated rows do. A null key
is a key of its own and differs from the text ``null``. An empty table gives an
empty result. Extra columns are kept; the two added ones take names that the
table does not have if theirs are in use.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cropline.llm.common import column, fresh

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(128))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that owns each slot."""
    if not _is_prime(slots) or not 0 < len(set(shards)) == len(shards) <= min(slots, 1 << 16):
        raise ValueError("needs a prime number of slots and distinct shards, at most one per slot")
    owner, free = [-1] * slots, slots
    walks = []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        offset = int.from_bytes(digest[:8], "big") % slots
        step = int.from_bytes(digest[8:], "big") % (slots - 1) + 1
        walks.append([offset, step])
    while free:
        for shard, walk in enumerate(walks):
            while owner[walk[0]] >= 0:
                walk[0] = (walk[0] + walk[1]) % slots
            owner[walk[0]] = shard
            free -= 1
            if not free:
                break
    return owner


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``(_slot, _shard)``: the filled table, two bytes a slot in the plan."""
    packed = b"".join(n.to_bytes(2, "big") for n in fill_table(shards, slots))
    two = F.lit(bytearray(packed)).substr((F.col("id") * 2 + 1).cast("int"), F.lit(2))
    number = F.conv(F.hex(two), 16, 10).cast("int")
    return spark.range(slots).select(
        F.col("id").alias("_slot"), F.element_at(F.array(*[F.lit(s) for s in shards]), number + 1).alias("_shard")
    )


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key, from the first 60 bits of its MD5."""
    text = F.when(key.isNull(), "n").otherwise(F.concat(F.lit("k"), key.cast("string")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % slots


def place(rows: DataFrame, key_column: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``rows`` with columns ``slot`` and ``shard``."""
    slot, shard = fresh(rows.columns, "slot"), fresh(rows.columns, "shard")
    own = fresh([*rows.columns, slot, shard], "_own_slot")
    table = lookup_table(rows.sparkSession, shards, slots).select(F.col("_slot").alias(own), F.col("_shard").alias(shard))
    placed = rows.withColumn(slot, slot_of(column(key_column), slots))
    return placed.join(F.broadcast(table), F.col(slot) == F.col(own)).drop(own)


def write_shards(
    rows: DataFrame, path: str, key_column: str, files: int = 1, shards: Sequence[str] = SHARDS, slots: int = SLOTS
) -> None:
    """Write one folder per shard, with ``files`` files of about equal size each."""
    placed = place(rows, key_column, shards, slots)
    shard = placed.columns[-1]
    part = F.pmod(F.xxhash64(*[column(c) for c in rows.columns]), F.lit(files))
    placed.repartition(len(shards) * files, shard, part).write.partitionBy(shard).parquet(path)
