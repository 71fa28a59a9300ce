"""Sharding with a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size. Shards take turns, each claiming the next free
slot in its order of preference, until the table is full. So every shard holds nearly the same number of slots (in proportion
to its weight), and adding or removing a shard moves few of them. A row is placed by one hash and one look into the table.
The table has a fixed number of slots, whatever the input, so it may be broadcast.

Defined results: a null key is placed like the empty string; equal keys go to one shard; ``salted`` placement spreads the
rows of a key that is too frequent over several slots, by a second column; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table: a prime, some hundred times the number of shards.
SLOTS = 65_537


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")


def fill_table(shards: list[str], weights: list[float] | None = None, slots: int = SLOTS) -> np.ndarray:
    """The shard (its index) of each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need names that differ, one at least")
    if slots <= len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime larger than the number of shards")
    weights = weights or [1.0] * len(shards)
    if len(weights) != len(shards) or min(weights) <= 0:
        raise ValueError("weights are positive, one for each shard")
    table = np.full(slots, -1, np.int32)
    start = [_number(f"{s}/offset") % slots for s in shards]
    skip = [_number(f"{s}/skip") % (slots - 1) + 1 for s in shards]
    at, credit, top, free = [0] * len(shards), [0.0] * len(shards), max(weights), slots
    while free:
        for k in range(len(shards)):
            credit[k] += weights[k] / top
            if credit[k] < 1:
                continue
            credit[k] -= 1
            while table[slot := (start[k] + at[k] * skip[k]) % slots] >= 0:
                at[k] += 1
            table[slot] = k
            free -= 1
            if not free:
                break
    return table


def table_frame(spark: SparkSession, shards: list[str], weights: list[float] | None = None, slots: int = SLOTS) -> DataFrame:
    return spark.createDataFrame(list(enumerate(fill_table(shards, weights, slots).tolist())), "slot long, shard int")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A slot from the first 60 bits of the key's MD5: the same on every engine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots


def place(df: DataFrame, key: str, shards: list[str], weights: list[float] | None = None, slots: int = SLOTS, salt: str | None = None) -> DataFrame:
    """``df`` with the columns ``slot`` and ``shard``; columns of these names are replaced. ``salt``: a column whose values spread one key."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    text = F.concat_ws("\x1f", text, F.coalesce(F.col(salt).cast("string"), F.lit(""))) if salt else text
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    return df.select(*keep, slot_of(text, slots).alias("slot")).join(F.broadcast(table_frame(df.sparkSession, shards, weights, slots)), "slot").select(*keep, "slot", "shard")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Writes placed rows as one folder per shard; slots spread a shard over ``files_per_shard`` tasks."""
    n = F.col("slot") % files_per_shard
    placed.repartition("shard", n).write.partitionBy("shard").parquet(path)
