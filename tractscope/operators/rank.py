"""Top rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1,
                  rank_col: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group by ``order`` (``row_number``).

    ``order`` must end with unique columns so ties are decided.  Spark
    plans a partial ``WindowGroupLimit`` before the shuffle (for ``n`` up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``, 10,000 in this
    library's session), so each map task forwards at most ``n`` rows per
    group: a group holding a third of all rows is cut down before it reaches
    its one window task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rn = rank_col or "__rn"
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= n)
    return out if rank_col else out.drop(rn)


def top_one_per_group(df: DataFrame, keys: Sequence[str], weight: str, label: str,
                      label_out: str | None = None) -> DataFrame:
    """For each group the ``label`` with the largest ``weight`` (ties to the
    lowest label; null labels last).  An aggregate of ``min(struct)``:
    partial per map task, so hot groups are combined before the shuffle
    and no window sort is needed."""
    best = F.min(F.struct(
        F.col(label).isNull().alias("null_label"),
        (-F.col(weight)).alias("neg_weight"),
        F.col(label).alias("label"),
    )).alias("__best")
    return df.groupBy(*keys).agg(best).select(
        *keys,
        F.col("__best.label").alias(label_out or label),
        (-F.col("__best.neg_weight")).alias(weight),
    )


def first_k_by(df: DataFrame, col: str, k: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` rows by ``col`` (then ``tiebreak``), nulls last: each
    task keeps ``k`` rows, one task merges them.  For reports whose ``k`` is a
    feature; it is not a way to sample (see ``spatial.stable_sample``)."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in (col, *tiebreak)]).limit(k)


def rank_all(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank_col: str = "rank") -> DataFrame:
    """``row_number`` of every row within its group, without a task that holds
    a whole group.

    Rows are range partitioned by (keys, order): Spark samples the splits and
    a group may span many tasks.  Each task numbers its stretch, and the counts
    per (task, group), one row per task and group met in it, shift the numbers.
    ``order`` must end with unique columns (a group of equal rows is one
    stretch).  The numbered rows are written once, so the numbers are fixed."""
    row, task = "__row", "__task"
    by = [*[F.col(f"`{k}`").asc_nulls_first() for k in keys], *order]
    rows = reliable_checkpoint(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(row, F.monotonically_increasing_id()))
    rows = rows.withColumn(task, F.shiftright(F.col(row), 33))
    counts = rows.groupBy(*keys, task).agg(F.count(F.lit(1)).alias("__n"), F.min(row).alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy(task).rowsBetween(Window.unboundedPreceding, -1))
    names = [f"__k{i}" for i in range(len(keys))]
    shift = counts.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.col(task).alias("__t"),
                          (F.coalesce(before, F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    same = F.col(task) == F.col("__t")
    for k, n in zip(keys, names):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(n))
    # ranges are contiguous: tasks + groups rows at most
    joined = rows.join(F.broadcast(shift) if shift.count() <= 250_000 else shift, same)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(row) + F.col("__shift")).alias(rank_col))
