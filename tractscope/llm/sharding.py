"""Sharding by jump consistent hashing (Lamping and Veach).

A 64-bit key walks a pseudo-random sequence of jumps; the last jump below the
number of shards is its shard.  No ring or table is kept: the key and the
number decide.  Appending a shard moves about one row in (shards + 1), and only
into the new shard.

Rows get ``slot``, their number within the shard (gapless from 0, by key, then
the order columns), without any task seeing a whole shard: rows are range
partitioned over many tasks, each task numbers what it holds, and the counts
per (task, shard) shift the numbers.

Keys: an integer key is hashed as it is (its 64 bits); any other key, or several
columns, by xxhash64.  Null keys share one shard, that of key 0.

Defined cases: a null text has no bytes (size 1, checksum 0), an empty one
likewise; repeated rows share the shard and have slots of their own; an empty
table gives an empty result; other columns, whatever their names, take no part
in :func:`shard_rows` and pass through :func:`with_shard`.  One key may hold any
share of the rows: ties are split over tasks by a row's place in the written
table, which decides nothing but the order of equal rows.

Scale: one pass over the texts, which never move; one shuffle of a few numbers
per row; the counts are one row per (task, shard met by it).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, saved

SHARDS = 8
# The generator's multiplier and the scale of its upper bits.
MULTIPLIER, SCALE, SHIFT = 2862933555777941757, 1 << 31, 33


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key among ``shards``."""
    if shards < 1:
        raise ValueError("at least one shard")
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), dtype=np.int64)
    going, at = np.arange(len(state)), np.zeros(len(state), dtype=np.int64)
    while len(going):
        shard[going] = at
        state = state * np.uint64(MULTIPLIER) + np.uint64(1)
        upper = (state >> np.uint64(SHIFT)).astype(np.float64) + 1.0
        at = ((at + 1) * (SCALE / upper)).astype(np.int64)
        on = at < shards
        going, state, at = going[on], state[on], at[on]
    return shard


def stable_key(df: DataFrame, key: str | Sequence[str]) -> Column:
    """The 64-bit key of a row."""
    names = [key] if isinstance(key, str) else list(key)
    if len(names) == 1 and isinstance(df.schema[names[0]].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(F.col(f"`{names[0]}`").cast("long"), F.lit(0).cast("long"))
    cols = [F.col(f"`{c}`") for c in names]
    known = F.lit(False)
    for c in cols:
        known = known | c.isNotNull()
    return F.when(known, F.xxhash64(*cols)).otherwise(F.lit(0).cast("long"))


def shard_of(key: Column, shards: int) -> Column:
    """Column: the shard of a 64-bit key, in Arrow batches."""
    @F.pandas_udf("int")
    def jumped(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(dtype=np.int64), shards).astype(np.int32))

    return jumped(key)


def with_shard(df: DataFrame, shards: int = SHARDS, key: str | Sequence[str] = "doc_id", shard_col: str = "shard") -> DataFrame:
    """``df`` with the shard of each row, e.g. for ``write.partitionBy(shard_col)``."""
    if shard_col in df.columns:
        raise ValueError(f"column exists: {shard_col}")
    arrow_batches(df.sparkSession)
    return df.withColumn(shard_col, shard_of(stable_key(df, key), shards))


def numbered(df: DataFrame, group: str, order: Sequence[str], name: str = "slot") -> DataFrame:
    """``df`` with a number per row of each ``group``, gapless from 0, by
    ``order``, for a table whose columns are few and narrow (it is written twice).

    Equal rows may be numbered in any order.  No task holds a whole group, and
    no rows but counts per (task, group) are gathered."""
    place, row, task = f"__{name}_place", f"__{name}_row", f"__{name}_task"
    at = saved(df).withColumn(place, F.monotonically_increasing_id())  # places of written rows are fixed
    by = [F.col(f"`{c}`") for c in (group, *order)] + [F.col(place)]
    dealt = at.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(row, F.monotonically_increasing_id())
    rows = saved(dealt.drop(place)).withColumn(task, F.shiftright(F.col(row), SHIFT))
    counts = rows.groupBy(group, task).agg(F.count("*").alias("__n"), F.min(row).alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy(task).rowsBetween(Window.unboundedPreceding, -1))
    shift = counts.select(F.col(group).alias("__g"), F.col(task).alias("__t"), (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    # one row per task and group in it: bounded by tasks + groups, since tasks hold ranges of (group, order)
    joined = rows.join(F.broadcast(shift), F.col(task).eqNullSafe(F.col("__t")) & F.col(group).eqNullSafe(F.col("__g")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(row) + F.col("__shift")).alias(name))


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, size, text_crc32, law, shard, slot, grown_shard),
    the last being its shard once another is appended."""
    arrow_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    key = stable_key(docs, id_col)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       shard_of(key, shards).alias("shard"), shard_of(key, shards + 1).alias("grown_shard"))
    out = numbered(rows, "shard", ["id", "text_crc32", "size"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
