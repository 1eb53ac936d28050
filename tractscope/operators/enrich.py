"""Joins of incidents to tract income (J1, J1b) and cells to regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import MAX_BROADCAST_ROWS, join_small

TRACT_COLUMNS = ["spa", "med_hh_income", "ami_category"]


def enrich_fanout(incidents: DataFrame, tracts: DataFrame, salt_buckets: int = 256,
                  max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Parity join: every incident joined to each distinct
    ``(spa, med_hh_income, ami_category)`` of its region (left join), so a
    region's incidents are repeated once per distinct income there.

    The distinct triples are bounded by the tract table, not by the region
    count, so their size is checked before broadcasting; beyond the limit
    the few region keys are salted."""
    right = tracts.filter(F.col("spa").isNotNull()).select(*TRACT_COLUMNS).distinct()
    return join_small(incidents, right, "spa", "left", max_broadcast_rows=max_broadcast_rows,
                      salt_buckets=salt_buckets)


FANOUT_WEIGHT = "fan_w"
FANOUT_INCOME_SUM = "fan_income_sum"
FANOUT_INCOME_N = "fan_income_n"


def fanout_weights(tracts: DataFrame) -> DataFrame:
    """Per region, what the fan-out join would attach to each incident:
    how many rows it becomes (distinct income triples), and the sum and
    number of their non-null incomes."""
    triples = tracts.filter(F.col("spa").isNotNull()).select(*TRACT_COLUMNS).distinct()
    return triples.groupBy("spa").agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum("med_hh_income").alias(FANOUT_INCOME_SUM),
        F.count("med_hh_income").alias(FANOUT_INCOME_N),
    )


def enrich_fanout_weighted(incidents: DataFrame, tracts: DataFrame) -> DataFrame:
    """The fan-out join (J1) without its rows: each incident keeps one row
    and carries ``fan_w`` (how many rows J1 gives it, at least 1 since the
    join is a left join), ``fan_income_sum`` and ``fan_income_n``.  A count
    over J1 is ``sum(fan_w)``, a mean of an incident column is the
    ``fan_w``-weighted mean and the mean income is
    ``sum(fan_income_sum) / sum(fan_income_n)`` - the same answers without
    multiplying the table.  The right side has one row per region label of
    the tract table; they are counted before it is broadcast."""
    joined = join_small(incidents, fanout_weights(tracts), "spa", "left", salt_buckets=256)
    return joined.withColumns({
        FANOUT_WEIGHT: F.coalesce(F.col("__n"), F.lit(1)).cast("long"),
        FANOUT_INCOME_N: F.coalesce(F.col(FANOUT_INCOME_N), F.lit(0)).cast("long"),
    }).drop("__n")


def region_income(tracts: DataFrame) -> DataFrame:
    """One row per region: mean tract income and the most common income
    category (highest count, ties to the lowest label, nulls ignored)."""
    return tracts.filter(F.col("spa").isNotNull()).groupBy("spa").agg(
        F.avg("med_hh_income").alias("med_hh_income"),
        F.mode("ami_category", deterministic=True).alias("ami_category"),
    )


def enrich_region(incidents: DataFrame, tracts: DataFrame) -> DataFrame:
    """Default join: each incident gets its region's income once (row
    count kept).  The right side has one row per region label of the tract
    table (whatever labels it holds); they are counted, and within the limit
    it is broadcast, so the incident side is never shuffled."""
    return join_small(incidents, region_income(tracts), "spa", "left", salt_buckets=256)


def label_cells(cells: DataFrame, cell_region: DataFrame,
                keys: tuple[str, str] = ("lat_i", "lon_i"), max_cells: int | None = None) -> DataFrame:
    """Left join of cells to the dominant region of each cell, on the
    integer cell indexes (never on the derived doubles).

    The cell set is the small side: its keys semi-filter ``cell_region``
    (one row per cell), so both joins see at most as many rows as there
    are cells.  ``max_cells`` is that bound when the caller knows it (a
    top-K gives K); otherwise the cells are counted once."""
    k = list(keys)
    bound = max_cells if max_cells is not None else cells.count()
    wanted = join_small(cell_region, cells.select(*k), k, "left_semi", known_rows=bound)
    return join_small(cells, wanted.select(*k, "spa"), k, "left", known_rows=bound)
