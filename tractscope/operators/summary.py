"""Grouped reports (A1-A26).  Every aggregate is partial + final, so a
key holding a third of all rows is combined on the map side before the
shuffle.

``weight`` names a per-row multiplicity column (``fan_w`` of
``enrich_fanout_weighted``): counts become ``sum(weight)`` and means become
weighted means, which equals the report over the row-multiplied fan-out
join without building it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as X
from .enrich import FANOUT_INCOME_N, FANOUT_INCOME_SUM


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def n_rows(weight: str | None = None) -> Column:
    """Row count, or the sum of the multiplicity column."""
    return F.sum(weight).cast("long") if weight else F.count(F.lit(1))


def mean_of(value: str | Column, weight: str | None = None) -> Column:
    """Mean of a column (nulls skipped); weighted by ``weight`` if given.
    With integer values the weighted sums are exact, so the result equals
    the plain mean over the multiplied rows bit for bit."""
    v = F.col(value) if isinstance(value, str) else value
    if not weight:
        return F.avg(v)
    w = F.col(weight)
    return F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))


def income_mean(weight: str | None = None) -> Column:
    """Mean income: of the joined income, or - on a weighted fan-out frame -
    over every income row the fan-out join would have produced."""
    if not weight:
        return F.avg("med_hh_income")
    return F.try_divide(F.sum(FANOUT_INCOME_SUM), F.sum(FANOUT_INCOME_N))


def count_by(df: DataFrame, keys: str | Sequence[str], n: int | None = None,
             weight: str | None = None) -> DataFrame:
    """Rows per group (null keys form their own group).  With ``n`` the
    ``n`` largest groups, ties to the lowest key."""
    ks = _keys(keys)
    out = df.groupBy(*ks).agg(n_rows(weight).alias("count"))
    if n is None:
        return out.orderBy(*[F.col(k).asc_nulls_last() for k in ks])
    return out.orderBy(F.col("count").desc(), *[F.col(k).asc_nulls_last() for k in ks]).limit(n)


def top_counts(df: DataFrame, keys: str | Sequence[str], n: int = 10,
               weight: str | None = None) -> DataFrame:
    """Global top-``n`` groups by row count (``TakeOrderedAndProject``:
    each task keeps ``n`` rows, one task merges them)."""
    return count_by(df, keys, n, weight)


def mean_by(df: DataFrame, key: str, value: str, n: int | None = None,
            out: str = "mean", weight: str | None = None) -> DataFrame:
    """Mean of ``value`` per ``key`` (nulls skipped), largest first."""
    agg = df.groupBy(key).agg(mean_of(value, weight).alias(out))
    ordered = agg.orderBy(F.col(out).desc_nulls_last(), F.col(key).asc_nulls_last())
    return ordered.limit(n) if n else ordered


def share_by(df: DataFrame, keys: str | Sequence[str], weight: str | None = None) -> DataFrame:
    """Rows per group and their percent of all rows.  The total is a
    scalar subquery over the (already aggregated) groups - Spark reuses
    their shuffle - instead of a second pass or a single-partition window."""
    ks = _keys(keys)
    counts = df.groupBy(*ks).agg(n_rows(weight).alias("count"))
    total = counts.select(F.sum("count")).scalar()
    return counts.withColumn("pct", F.lit(100.0) * F.col("count") / total)


def series_by(df: DataFrame, group: str, order_key: str, weight: str | None = None) -> DataFrame:
    """One ordered count series per group, in long form: ``(group, key,
    count, step)`` where ``step`` numbers the keys of a group from 1.  The
    window runs over the aggregated rows only (one per group and key)."""
    counts = df.groupBy(group, order_key).agg(n_rows(weight).alias("count"))
    w = Window.partitionBy(group).orderBy(F.col(order_key).asc_nulls_last())
    return counts.withColumn("step", F.row_number().over(w))


def pivot_counts(df: DataFrame, row_key: str, col_key: str, values: Sequence[str],
                 weight: str | None = None) -> DataFrame:
    """Counts with ``col_key`` values as columns; a missing pair stays
    null.  Values are given, so Spark needs no extra job to find them."""
    return df.groupBy(row_key).pivot(col_key, list(values)).agg(n_rows(weight))


def income_vs_count(df: DataFrame, weight: str | None = None) -> DataFrame:
    return df.groupBy("spa").agg(
        income_mean(weight).alias("avg_income"),
        n_rows(weight).alias("crime_count"),
    )


def _profile_measures(weight: str | None = None) -> list:
    weapon = F.when(F.col("Weapon_Used_Cd").isNotNull(), 1).otherwise(0)
    return [
        n_rows(weight).alias("crime_count"),
        income_mean(weight).alias("avg_income"),
        mean_of("Vict_Age", weight).alias("avg_victim_age"),
        mean_of(weapon, weight).alias("weapon_rate"),
    ]


def region_profile(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Per region: incidents, mean income, mean victim age, weapon rate;
    rows with any null (regions without income) dropped."""
    return (df.filter(F.col("spa").isNotNull()).groupBy("spa")
            .agg(*_profile_measures(weight)).na.drop())


def region_month_panel(df: DataFrame, weight: str | None = None) -> DataFrame:
    """The same four measures per region x year x month."""
    return (df.filter(F.col("spa").isNotNull())
            .groupBy("spa", "Occured_Year", "Occured_Month").agg(*_profile_measures(weight)).na.drop())


def cell_region_counts(df: DataFrame, scale: int = 500, weight: str | None = None) -> DataFrame:
    """Incidents per grid cell x region (no city-box filter; rows with a
    null cell or region dropped)."""
    cells = df.select(
        X.grid_index(F.col("LAT").cast("double"), scale).alias("lat_i"),
        X.grid_index(F.col("LON").cast("double"), scale).alias("lon_i"),
        "spa", *([weight] if weight else []),
    ).na.drop(subset=["lat_i", "lon_i", "spa"])
    return (cells.groupBy("lat_i", "lon_i", "spa").agg(n_rows(weight).alias("n"))
            .withColumns({"lat_grid": F.col("lat_i") / scale, "lon_grid": F.col("lon_i") / scale}))
