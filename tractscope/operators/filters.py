"""User filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import join_small


def apply_filters(df: DataFrame, regions: Sequence[str] = (), years: Sequence[int] = (),
                  months: Sequence[int] = ()) -> DataFrame:
    """Conjunction of ``isin`` filters; an empty list means all values.
    ``isin`` reaches the Parquet scan as a pushed ``In`` filter."""
    out = df
    if regions:
        out = out.filter(F.col("spa").isin(*regions))
    if years:
        out = out.filter(F.col("Occured_Year").isin(*years))
    if months:
        out = out.filter(F.col("Occured_Month").isin(*months))
    return out


def latest_years(df: DataFrame, n: int = 3, col: str = "Occured_Year") -> DataFrame:
    """The ``n`` most recent distinct non-null years (all, if fewer)."""
    return (df.select(col).filter(F.col(col).isNotNull()).distinct()
            .orderBy(F.col(col).desc()).limit(n))


def filter_latest_years(df: DataFrame, n: int = 3, col: str = "Occured_Year") -> DataFrame:
    """Keep rows of the latest ``n`` years: a left-semi join with a side of
    at most ``n`` rows (bounded by the limit), broadcast."""
    return join_small(df, latest_years(df, n, col), col, "left_semi", known_rows=n)


def filter_years_known(df: DataFrame, years: Sequence[int], n: int = 3, col: str = "Occured_Year") -> DataFrame:
    """The latest ``n`` of ``years`` known beforehand (partition values, a
    manifest): a literal filter that prunes the scan, and no pass to find them."""
    latest = sorted({int(y) for y in years}, reverse=True)[:n]
    return df.filter(F.col(col).isin(*latest)) if latest else df.limit(0)


def filter_defaults_known(df: DataFrame, years: Sequence[int], n_years: int = 3) -> DataFrame:
    """:func:`filter_defaults` with the table's years known beforehand: one scan."""
    return filter_years_known(df, years, n_years).filter(F.col("Occured_Month").isNotNull())


def filter_defaults(df: DataFrame, n_years: int = 3) -> DataFrame:
    """The report's default choice: every region, the latest ``n_years``
    years and every listed (non-null) month."""
    return filter_latest_years(df, n_years).filter(F.col("Occured_Month").isNotNull())


def filtered_count(df: DataFrame, **filters) -> DataFrame:
    return apply_filters(df, **filters).agg(F.count(F.lit(1)).alias("n_rows"))


def selected_regions(df: DataFrame, regions: Sequence[str] = (), **filters) -> DataFrame:
    """How many regions the selection covers (all distinct, if none)."""
    return apply_filters(df, regions=regions, **filters).agg(
        F.countDistinct("spa").alias("n_regions"))
