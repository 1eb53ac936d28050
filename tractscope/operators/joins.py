"""Join helpers that broadcast only a side of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows above which a "small" side is not broadcast (a few tens of bytes per
#: row: about 15 MB shipped to every executor at the limit)
MAX_BROADCAST_ROWS = 250_000
#: rows of one key that one task of a shuffle join should receive at most
TASK_ROWS = 4_000_000
#: tasks over which rows with a null key are spread
NULL_SLICES = 256


def join_small(big: DataFrame, small: DataFrame, on: list[str] | str, how: str = "left",
               max_broadcast_rows: int = MAX_BROADCAST_ROWS, salt_buckets: int = 0,
               known_rows: int | None = None, salt_on: list[str] | None = None) -> DataFrame:
    """Join ``big`` to a side expected to be small.

    The small side is counted first (``known_rows`` skips the count when a
    bound is structural).  Within ``max_broadcast_rows`` it is broadcast, so
    ``big`` is never shuffled.  Beyond it, the join is a shuffle join; where
    single keys may hold much of ``big`` (``salt_buckets > 0``) those are
    measured and spread over at least ``salt_buckets`` tasks each
    (:func:`join_hot`).
    """
    keys = [on] if isinstance(on, str) else list(on)
    n = known_rows if known_rows is not None else small.count()
    if n <= max_broadcast_rows:
        return big.join(F.broadcast(small), keys, how)
    if salt_buckets <= 0:
        return big.join(small, keys, how)
    return join_hot(big, small, keys, how, least_slices=salt_buckets, salt_on=salt_on)


def hot_keys(big: DataFrame, keys: list[str], task_rows: int = TASK_ROWS, least_slices: int = 2) -> DataFrame:
    """(keys, ``__slices``) of the keys that hold more than ``task_rows`` rows:
    at most rows / ``task_rows`` of them, counted with a partial aggregate."""
    counts = big.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > task_rows)
    slices = F.greatest(F.ceil(F.col("__n") / F.lit(task_rows)), F.lit(least_slices)).cast("long")
    return counts.select(*keys, slices.alias("__slices"))


def join_hot(big: DataFrame, small: DataFrame, on: list[str] | str, how: str = "left", task_rows: int = TASK_ROWS,
             least_slices: int = 2, salt_on: list[str] | None = None) -> DataFrame:
    """Shuffle join in which a key that holds more than ``task_rows`` rows of
    ``big`` is dealt into slices by a hash of the row (of ``salt_on``, by
    default its first column that is no key); only the rows of ``small`` with
    such a key are copied, once per slice, all others travel once.

    The hot keys are measured on ``big`` (one pass over the key columns) and
    are few by their definition.  A replicated side must not be kept where it
    does not match, so joins that keep its rows (right, full) are refused.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how.lower().replace("_", "").replace("outer", "") in ("right", "full", ""):
        raise ValueError(f"a salted join cannot keep unmatched rows of the replicated side: {how}")
    hot = hot_keys(big.na.drop(subset=keys), keys, task_rows, least_slices)
    # each is a key of over task_rows rows, so the list is small beside the table; beyond the bound it is joined by shuffle
    rows = hot.count()
    held = F.broadcast(hot) if rows <= MAX_BROADCAST_ROWS else hot
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in salt_on or [c for c in big.columns if c not in keys][:1] or keys])
    one = F.lit(1).cast("long")
    # a null key meets nothing, so its rows may go anywhere
    unmatched = F.lit(False)
    for k in keys:
        unmatched = unmatched | F.col(f"`{k}`").isNull()
    slices = F.when(unmatched, F.lit(NULL_SLICES)).otherwise(F.coalesce(F.col("__slices"), one))
    left = big.join(held, keys, "left").withColumn("__salt", F.pmod(row_hash, slices)).drop("__slices")
    right = replicated(small, held, keys)
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def replicated(small: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``small`` with ``__salt``: a row per slice of a hot key, one row otherwise."""
    last = F.coalesce(F.col("__slices"), F.lit(1).cast("long")) - 1
    return small.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("__slices")
