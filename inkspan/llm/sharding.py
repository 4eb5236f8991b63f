"""Sharding by a permutation-filled lookup table.

Each shard walks its own permutation of the slots of a prime-sized table; the
shards take turns claiming their next free slot until the table is full. A key
is hashed to a slot, so placement is one lookup in a broadcast table, loads
differ by a slot at most, and adding a shard moves few keys.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.columns import unused, without

TABLE_SIZE = 65_537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index in ``shards``. ``size`` must be a prime of at least the shard count."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    if size < len(shards) or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime, no less than the shard count")
    place = [_number(f"offset:{s}") % size for s in shards]
    step = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    table, claimed = [-1] * size, 0
    while True:
        for i in range(len(shards)):
            while table[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % size
            table[place[i]] = i
            claimed += 1
            if claimed == size:
                return table


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: 60 bits of its text's MD5, modulo the table size; null counts as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size))


def assign_shards(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot long``, ``shard_id int`` (index in ``shards``) and ``shard string``.

    Rows keep their place: nothing is shuffled. What is broadcast has ``size``
    rows, whatever the data's size. Equal keys share a shard; null keys go where
    the empty key goes. Input columns named like an output are replaced by it.
    """
    rows = without(df, *({"slot", "shard_id", "shard"} - {key}))
    if key in ("slot", "shard_id", "shard"):
        raise ValueError("the key column may not have an output's name")
    (at,) = unused(rows, "table_slot")
    table = df.sparkSession.createDataFrame(
        [(at_, i, shards[i]) for at_, i in enumerate(lookup_table(shards, size))], f"`{at}` long, shard_id int, shard string"
    )
    placed = rows.withColumn("slot", slot(F.col(key), size))
    return placed.join(F.broadcast(table), placed["slot"] == table[at], "left").drop(at)


def write_shards(df: DataFrame, path: str, key: str, shards: list[str], size: int = TABLE_SIZE, files_per_shard: int = 1) -> None:
    """Write one folder per shard, ``files_per_shard`` files each, dealt by the key's hash."""
    placed = assign_shards(df, key, shards, size)
    spread = F.pmod(F.xxhash64(F.col(key)), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, F.col("shard_id"), spread).drop("slot", "shard").write.partitionBy("shard_id").parquet(path)
