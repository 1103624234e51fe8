"""Placement of keys on shards by a permutation-filled lookup table; DataFrame functions only."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_names

#: Slots; a prime of at least a hundred times the shards keeps their loads within about 1 %.
SLOTS = 65537
SHARDS = 256


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


@cache
def lookup_table(shards: tuple[str, ...], slots: int = SLOTS) -> tuple[int, ...]:
    """The index in ``shards`` of each slot.

    Each shard has its own order of all slots (an offset and a step modulo the prime); in turns each
    claims its next free one. When a shard goes, most other slots keep their owner.
    """
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct, at least one, at most as many as slots")
    place = [_number(f"offset:{s}") % slots for s in shards]
    step = [_number(f"step:{s}") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for k in range(len(shards)):
            while table[place[k]] >= 0:
                place[k] = (place[k] + step[k]) % slots
            table[place[k]] = k
            left -= 1
            if not left:
                break
    return tuple(table)


def shard_names(n: int = SHARDS) -> tuple[str, ...]:
    return tuple(f"shard-{k:05d}" for k in range(n))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """60 bits of the key's MD5 modulo the slots; a null key counts as the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: Column, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with shard_slot and shard (an index in ``shards``); rows of one key share a shard. Columns of
    ``df`` that have these names, letter case aside, give way to them.

    The table has ``slots`` rows, a parameter that no data enlarges, and is broadcast: placing is one
    hash and one lookup a row, without a shuffle. Null keys share one shard; empty input stays empty.
    """
    spark = df.sparkSession
    text = ",".join(map(str, lookup_table(tuple(shards), slots)))
    slot, shard = free_names(df.columns, "slot", "owner")
    table = spark.range(1).select(F.posexplode(F.split(F.lit(text), ",").cast("array<int>")).alias(slot, shard))
    out = df.withColumn(slot, slot_of(key, slots)).join(F.broadcast(table), slot)
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard_slot", "shard")]
    return out.select(*rest, F.col(slot).alias("shard_slot"), F.col(shard).alias("shard"))


def write_sharded(df: DataFrame, key: Column, shards: Sequence[str], path: str, per_shard: int = 1) -> None:
    """Parquet below one folder a shard. Rows are dealt by shard and a salt of ``per_shard`` values, so
    a shard can be written by several tasks."""
    placed = place(df, key, shards)
    salt = F.pmod(F.xxhash64(F.struct(*[F.col(f"`{c}`") for c in df.columns])), F.lit(per_shard))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)


def op8_oracle(n: int = SHARDS, slots: int = SLOTS) -> str:
    table = ",".join(map(str, lookup_table(shard_names(n), slots)))
    return f"""
WITH t AS (SELECT [{table}] AS a), d AS (
  SELECT doc_id, source, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {slots} AS INTEGER) AS shard_slot FROM documents)
SELECT doc_id, source, shard_slot, CAST(a[shard_slot + 1] AS INTEGER) AS shard FROM d, t
"""
