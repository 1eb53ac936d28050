"""Flagship: clean -> region -> income join -> valid points -> top-K
hotspot cells, each labelled with the region that dominates it.

One scan and two aggregate shuffles (``spatial.hotspots_with_region``):
it crosses cleaning, the bounded broadcast join (removed by Catalyst when
income is not read), partial/final aggregation, an argmax per group and a
top-K.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.spatial import hotspots_with_region
from . import frames as B


def flagship(spark: SparkSession, sf_dir: str, scale: int = 500, k: int = 8000) -> DataFrame:
    return hotspots_with_region(B.enriched(spark, sf_dir), scale, k)
