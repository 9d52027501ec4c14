"""Sharding by a permutation-filled lookup table, in DataFrame operations only.

Every shard has its own preference order of the slots of a table of prime size: a start and
a step taken from its name's md5. Shards take turns, each claiming the first slot of its
order that is still free, until the table is full; so the shards' shares differ by one slot
at most, and when a shard goes few slots change hands. The table depends on the shards'
names alone, has a fixed size (65,537 slots, under 1 MB) and is broadcast; a row's slot is
a hash of its key modulo the size.

A null key has a place of its own ('' is hashed). Equal keys go to the same shard, repeated
rows stay; rows are never moved to compute it, so a hot key or source costs nothing. An
empty input gives an empty output. Columns named `slot` or `shard` are replaced, all others
pass through.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import documents, packed, unpacked

SLOTS, SHARDS = 65_537, 64
HEX = 15


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HEX], 16)


@lru_cache(8)
def lookup_table(shards: tuple[str, ...], slots: int = SLOTS) -> tuple[int, ...]:
    """For each slot the index of the shard that claimed it."""
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards are distinct, and no more than slots")
    if slots < 3 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots is a prime over 2")
    at = [_number(f"start:{x}") % slots for x in shards]
    step = [_number(f"step:{x}") % (slots - 1) + 1 for x in shards]
    table, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return tuple(table)


def names(n: int = SHARDS) -> tuple[str, ...]:
    return tuple(f"shard-{i:05d}" for i in range(n))


def place(df: DataFrame, key: str, shards: tuple[str, ...], slots: int = SLOTS) -> DataFrame:
    """`df` with `slot` and `shard` (the shard's index)."""
    flat = ",".join(map(str, lookup_table(shards, slots)))
    table = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(flat), ",")).alias("slot", "shard"))
    table = table.select("slot", F.col("shard").cast("int"))
    number = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, HEX), 16, 10).cast("bigint")
    rows = df.select(packed(df).alias("doc"), (number % slots).cast("int").alias("slot"))
    out = rows.join(F.broadcast(table), "slot")  # size fixed: `slots` rows
    return out.select(*unpacked(df, [c for c in df.columns if c not in ("slot", "shard")]), "slot", "shard")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(documents(spark, sf_dir).select("doc_id"), "doc_id", names())


def op10_sql() -> str:
    flat = ",".join(map(str, lookup_table(names())))
    return f"""
WITH t AS (SELECT string_split('{flat}', ',') AS shards)
SELECT doc_id, slot::INTEGER AS slot, shards[slot + 1]::INTEGER AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {HEX}))::BIGINT % {SLOTS} AS slot FROM documents), t
"""
