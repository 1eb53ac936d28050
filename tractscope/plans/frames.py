"""Named base frames of the test pipeline, built lazily from ``sf_dir``.

The lazy frames are memoized per session and folder, as a long-running
report keeps its loaded frame: later queries skip re-listing the files and
re-analysing the same cleaning plan.  Only plans and the places of stored
tables are kept, never data; ``forget`` drops them (e.g. after the folder's files change).
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from ..operators import clean as C
from ..operators import cube
from ..operators import enrich as J
from ..operators.cube import CountCube
from ..session import ensure_checkpoint_dir
from ..sources import layout, load_incidents, load_tracts
from ..sources.files import write_table

Held = TypeVar("Held")
_SLOT = "_tractscope_frames"  # kept on the session, so the frames go with it


def _memo(fn: Callable[[SparkSession, str], Held]) -> Callable[[SparkSession, str], Held]:
    @functools.wraps(fn)
    def wrapper(spark: SparkSession, d: str) -> Held:
        frames = spark.__dict__.setdefault(_SLOT, {})
        key = (fn.__name__, d)
        if key not in frames:
            frames[key] = fn(spark, d)
        return frames[key]
    return wrapper


def forget(spark: SparkSession) -> None:
    """Drop the session's memoized frames."""
    spark.__dict__.pop(_SLOT, None)


@_memo
def raw_incidents(spark: SparkSession, d: str) -> DataFrame:
    return load_incidents(spark, d)


@_memo
def renamed(spark: SparkSession, d: str) -> DataFrame:
    return C.standardize_columns(raw_incidents(spark, d))


@_memo
def clean(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_incidents(raw_incidents(spark, d))


@_memo
def raw_tracts(spark: SparkSession, d: str) -> DataFrame:
    return load_tracts(spark, d)


@_memo
def tracts(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_tracts(raw_tracts(spark, d))


@_memo
def regioned(spark: SparkSession, d: str) -> DataFrame:
    return C.map_area_to_region(clean(spark, d))


@_memo
def enriched(spark: SparkSession, d: str) -> DataFrame:
    """One income row per region (the default)."""
    return J.enrich_region(regioned(spark, d), tracts(spark, d))


@_memo
def enriched_fanout(spark: SparkSession, d: str) -> DataFrame:
    """The parity fan-out join."""
    return J.enrich_fanout(regioned(spark, d), tracts(spark, d))


@_memo
def geo(spark: SparkSession, d: str) -> DataFrame:
    return C.valid_geo(enriched(spark, d))


@_memo
def enriched_weighted(spark: SparkSession, d: str) -> DataFrame:
    """J1 as weights: one row per incident with its fan-out multiplicity."""
    return J.enrich_fanout_weighted(regioned(spark, d), tracts(spark, d))


@_memo
def geo_fanout(spark: SparkSession, d: str) -> DataFrame:
    return C.valid_geo(enriched_weighted(spark, d))


@_memo
def enriched_both(spark: SparkSession, d: str) -> DataFrame:
    """J1b's income and J1's multiplicities on one row per incident."""
    return J.enrich_fanout_weighted(enriched(spark, d), tracts(spark, d))


@_memo
def stored_cube(spark: SparkSession, d: str) -> CountCube:
    """The count cube of the folder's incidents, stored once per session and
    folder in the shared checkpoint folder."""
    return cube.store(enriched_both(spark, d), f"{ensure_checkpoint_dir(spark)}/cube-{uuid.uuid4()}")


@_memo
def centers(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in rows of a table of centers, from ``supplier``: most inside the
    city, one in ten in the empty country around it."""
    k = "s_suppkey"
    return spark.read.parquet(f"{d}/supplier.parquet").selectExpr(
        f"{k} AS center_id",
        f"CASE WHEN {k} % 10 = 0 THEN 30.0D + CAST(({k} * 7) % 100 AS DOUBLE) * 0.1D ELSE 33.7D + CAST(({k} * 37) % 1000 AS DOUBLE) * 0.00065D END AS center_lat",
        f"CASE WHEN {k} % 10 = 0 THEN -125.0D + CAST(({k} * 11) % 100 AS DOUBLE) * 0.15D ELSE -118.7D + CAST(({k} * 91) % 1000 AS DOUBLE) * 0.00055D END AS center_lon")


@_memo
def stored_enriched(spark: SparkSession, d: str) -> str:
    """The enriched incidents as year-partitioned Parquet, stored once per
    session and folder; the place."""
    path = f"{ensure_checkpoint_dir(spark)}/enriched-{uuid.uuid4()}"
    write_table(enriched(spark, d), path, partition_by=["Occured_Year"], sort_by=["LAT", "LON"])
    return path


@_memo
def published(spark: SparkSession, d: str) -> str:
    """The enriched incidents as a published table (layout by area, manifest); the place."""
    root = f"{ensure_checkpoint_dir(spark)}/published-{uuid.uuid4()}"
    layout.publish(enriched(spark, d), root)
    return root
