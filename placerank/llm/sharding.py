"""Sharding by jump consistent hashing.

A row's key and the number of shards alone decide its shard: the hash walks
the sequence of shard counts at which the key would move and stops before the
count asked for.  No ring table is kept, and appending a shard moves only the
rows that go to it, one in ``shards + 1`` of all (Lamping and Veach, 2014).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placerank.llm.common import column, others

# Multiplier and increment of the published generator.
_MULTIPLIER, _INCREMENT = np.uint64(2862933555777941757), np.uint64(1)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key; all keys jump together until each has landed."""
    state = keys.astype(np.uint64)
    landed = np.zeros(len(state), dtype=np.int64)
    moving = np.arange(len(state))
    at = np.zeros(len(state), dtype=np.int64)
    while moving.size:
        landed[moving] = at
        state[moving] = state[moving] * _MULTIPLIER + _INCREMENT
        draw = ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        at = ((landed[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        still = at < shards
        moving, at = moving[still], at[still]
    return landed.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards - 1``, of a stable key of any type; null is a key too."""
    if shards < 1:
        raise ValueError("shards must be positive")

    @F.pandas_udf("int")
    def landed(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(hashed.to_numpy().view(np.uint64), shards))

    return landed(F.xxhash64(key))


def assign_shards(
    docs: DataFrame,
    shards: int,
    key: str = "doc_id",
    text: str = "text",
    slot_groups: int = 256,
    slots: bool = True,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    ``size`` is the text's UTF-8 bytes plus 16, ``grown_shard`` the shard if there
    were one more.  ``slot`` numbers a shard's rows from 0 without gaps: rows are
    numbered within ``slot_groups`` hashed groups of a shard and shifted by the
    rows of the groups before, so no task sorts a whole shard.  The counts come
    from a pass over the keys alone; they are at most ``shards * slot_groups``
    rows, which is why they may be broadcast.

    Null text: size 16, checksum 0 (of no bytes).  Null keys share a shard.
    Repeated keys share a shard and get slots of their own; equal rows get
    interchangeable ones.  Empty input gives no rows.  Columns of the input that
    have a result's name are replaced.
    """
    names = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    content = F.coalesce(column(text), F.lit(""))
    group = F.pmod(F.xxhash64(column(key), F.lit(7)), F.lit(slot_groups)).cast("int")
    placed = docs.select(
        *[column(c) for c in others(docs, *names) if keep is None or c in keep],
        (F.octet_length(content) + 16).cast("long").alias("size"),
        F.crc32(content.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(column(key), shards).alias("shard"),
        shard_of(column(key), shards + 1).alias("grown_shard"),
        group.alias("__group"),
    )
    if not slots:
        return placed.drop("__group")
    counts = (
        docs.select(shard_of(column(key), shards).alias("shard"), group.alias("__group"))
        .groupBy("shard", "__group")
        .count()
    )
    before = Window.partitionBy("shard").orderBy("__group").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        "shard", "__group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy("shard", "__group").orderBy(column(key), "text_crc32", "size")
    numbered = placed.withColumn("__row", F.row_number().over(inside))
    return (
        numbered.join(F.broadcast(offsets), ["shard", "__group"])
        .withColumn("slot", (F.col("__before") + F.col("__row") - 1).cast("long"))
        .select(*others(placed, "__group"), "slot")
    )
