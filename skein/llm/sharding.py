"""Shards by jump consistent hashing (Lamping and Veach, 2014).

A stable key goes to one of ``shards`` shards by arithmetic alone; there is no
ring table to store or send.  With one more shard, a key stays where it was or
goes to the new shard, so only 1/(shards+1) of the rows move.

Cases: a null key is a key of its own (all such rows share a shard); rows that
repeat a key share its shard and get slots of their own; an empty table gives an
empty result; further columns are passed through by :func:`assign` and
:func:`with_slots` and cannot clash with their internal ones; a column with the
name of a result is an error of :func:`assign`; a text of any length is only
measured and summed up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import checkpointed, fresh

SHARDS = 24

# Fixed values of the published algorithm: its multiplier, shift and scale.
MULTIPLIER = np.uint64(2862933555777941757)
SHIFT = np.uint64(33)
SCALE = float(1 << 31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, for all keys at once; expected ln(shards) rounds."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    at = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    nxt = np.zeros(len(state))
    while len(live):
        at[live] = nxt[live].astype(np.int64)
        state[live] = state[live] * MULTIPLIER + np.uint64(1)
        nxt[live] = np.floor((at[live] + 1) * (SCALE / ((state[live] >> SHIFT).astype(np.float64) + 1)))
        live = live[nxt[live] < shards]
    return at


def jump_column(key: Column, shards: int) -> Column:
    """The shard of a long key as an int column."""
    if shards < 1:
        raise ValueError("there must be a shard at least")

    @pandas_udf("int")
    def of(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64), shards).astype(np.int32))

    return of(key)


def key_of(*columns: str) -> Column:
    """A stable 64-bit key of some columns; null and absent values have their own."""
    return F.xxhash64(*[c for name in columns for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))])


def assign(df: DataFrame, keys: list[str], shards: int = SHARDS) -> DataFrame:
    """``df`` with columns ``shard`` and ``grown_shard`` (its shard with one more)."""
    if taken := {"shard", "grown_shard"} & {c.lower() for c in df.columns}:
        raise ValueError(f"the table has columns {sorted(taken)} already")
    out = df.withColumn("shard", jump_column(key_of(*keys), shards))
    return out.withColumn("grown_shard", jump_column(key_of(*keys), shards + 1))


def with_slots(df: DataFrame, group: str, order: list[str], slot: str = "slot") -> DataFrame:
    """``df`` with a gapless 0-based long ``slot`` within each value of ``group``.

    Rows are numbered within (group, piece), where a piece is an input partition
    of the checkpointed table, so no task gets a whole group; the pieces' sizes
    are then summed up.  Rows in ties are interchangeable, and whichever gets
    which slot is settled once, since both passes read the same checkpoint.
    """
    piece, number, before, group_, piece_ = fresh(df, "piece", "number", "before", "of_group", "of_piece")
    held = checkpointed(df.withColumn(piece, F.spark_partition_id()))
    sizes = held.groupBy(group, piece).agg(F.count(F.lit(1)).alias(number))
    upto = Window.partitionBy(group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias(group_), F.col(piece).alias(piece_), F.coalesce(F.sum(number).over(upto), F.lit(0)).alias(before))
    within = Window.partitionBy(group, piece).orderBy(*order)
    numbered = held.withColumn(number, F.row_number().over(within))
    joined = numbered.join(starts, (F.col(group) == F.col(group_)) & (F.col(piece) == F.col(piece_)))
    return joined.withColumn(slot, (F.col(before) + F.col(number) - 1).cast("long")).select(*[F.col(f"`{c}`") for c in df.columns], slot)


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard, slot and the shard after growth of each document, with its size and checksum."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = assign(rows, ["doc_id"], shards).withColumn("law", F.lit("key"))
    return with_slots(placed, "shard", ["doc_id", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
