"""Queries on stored tables: the report's default view on year-partitioned
Parquet, whose years are known from folder names (one scan), and box, radius
and nearest extracts on a published table, which open only the files that can
hold the area and the chosen years (F1 with G1, G9)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import clean as C
from ..operators import filters as FL
from ..operators import spatial as G
from ..operators import summary as A
from ..sources import files as S
from ..sources import layout
from . import frames as B
from .catalog import (
    _BOX_WHERE,
    _F_WHERE,
    _NEAR_SRC,
    _PICKED_NEAR,
    BOX,
    CATALOG,
    CENTER,
    NEAREST_KM,
    PICK_MONTHS,
    PICK_REGIONS,
    PICK_YEARS,
    RADIUS_KM,
    SCALE,
    TOP_N,
    _count_sql,
    r6,
    register,
)
from .oracle import lit, q


def _sql(name: str) -> str:
    return CATALOG[name][1] or ""


def stored_years(spark, d) -> list[int]:
    return [int(y) for y in S.partition_values(spark, B.stored_enriched(spark, d), "Occured_Year")]


def stored_view(spark, d) -> DataFrame:
    """The default choice (F3) of the stored table: years as literals, one scan."""
    return FL.filter_defaults_known(S.read_table(spark, B.stored_enriched(spark, d)), stored_years(spark, d))


@register("filter_latest_years_stored", _sql("filter_latest_years"))
def filter_latest_years_stored(spark, d):
    stored = S.read_table(spark, B.stored_enriched(spark, d))
    return FL.filter_years_known(stored, stored_years(spark, d)).select("DR_NO", "Occured_Year")


@register("filter_defaults_stored", _sql("filter_defaults"))
def filter_defaults_stored(spark, d):
    return stored_view(spark, d).select("DR_NO", "spa", "Occured_Year", "Occured_Month")


@register("view_hotspots_stored", _sql("view_hotspots"))
def view_hotspots_stored(spark, d):
    return r6(G.add_weight(G.hotspots(C.valid_geo(stored_view(spark, d)), SCALE, 8000)), "weight")


@register("view_top_crimes_stored", _sql("view_top_crimes"))
def view_top_crimes_stored(spark, d):
    return A.top_counts(stored_view(spark, d), "Crm_Cd_Desc", TOP_N)


@register("view_income_vs_count_stored", _sql("view_income_vs_count"))
def view_income_vs_count_stored(spark, d):
    return r6(A.income_vs_count(stored_view(spark, d)), "avg_income")


@register("view_box_crimes_stored", _sql("view_box_crimes"))
def view_box_crimes_stored(spark, d):
    return A.top_counts(G.within_box(C.valid_geo(stored_view(spark, d)), *BOX), "Crm_Cd_Desc", TOP_N)


@register("view_radius_crimes_stored", _sql("view_radius_crimes"))
def view_radius_crimes_stored(spark, d):
    near = G.within_radius(C.valid_geo(stored_view(spark, d)), *CENTER, RADIUS_KM)
    return A.top_counts(near, "Crm_Cd_Desc", TOP_N)


def _opened(spark, d, box, years=()) -> DataFrame:
    return C.valid_geo(layout.read_current(spark, B.published(spark, d), box, years))


@register("within_box_published", _sql("within_box"))
def within_box_published(spark, d):
    return G.within_box(_opened(spark, d, BOX), *BOX).select("DR_NO", "LAT_d", "LON_d", "Crm_Cd_Desc")


@register("within_radius_published", _sql("within_radius"))
def within_radius_published(spark, d):
    near = G.within_radius(_opened(spark, d, G.radius_box(*CENTER, RADIUS_KM)), *CENTER, RADIUS_KM)
    return r6(near.select("DR_NO", "LAT_d", "LON_d", "dist_km"), "dist_km")


# Extracts under the report's choices of region, year and month.

_CHOSEN = dict(regions=PICK_REGIONS, months=PICK_MONTHS)


@register("box_crimes_chosen", q(_count_sql(f"(SELECT * FROM geo WHERE {_BOX_WHERE} AND {_F_WHERE})", ["Crm_Cd_Desc"], TOP_N)))
def box_crimes_chosen(spark, d):
    rows = FL.apply_filters(_opened(spark, d, BOX, PICK_YEARS), **_CHOSEN)
    return A.top_counts(G.within_box(rows, *BOX), "Crm_Cd_Desc", TOP_N)


@register("radius_crimes_chosen", q(_count_sql(f"(SELECT * FROM {_NEAR_SRC} WHERE dist_km <= {lit(RADIUS_KM)} AND {_F_WHERE})", ["Crm_Cd_Desc"], TOP_N)))
def radius_crimes_chosen(spark, d):
    rows = FL.apply_filters(_opened(spark, d, G.radius_box(*CENTER, RADIUS_KM), PICK_YEARS), **_CHOSEN)
    return A.top_counts(G.within_radius(rows, *CENTER, RADIUS_KM), "Crm_Cd_Desc", TOP_N)


@register("view_nearest_published", q(f'SELECT "DR_NO", round(dist_km, 6) AS dist_km FROM {_PICKED_NEAR} WHERE dist_km <= {lit(NEAREST_KM)} '
                                      f'ORDER BY dist_km, "DR_NO" LIMIT 50'))
def view_nearest_published(spark, d):
    rows = FL.apply_filters(_opened(spark, d, G.radius_box(*CENTER, NEAREST_KM), PICK_YEARS), **_CHOSEN)
    return r6(G.nearest(rows, *CENTER, NEAREST_KM, 50).select("DR_NO", "dist_km"), "dist_km")


@register("published_years", q('SELECT DISTINCT "Occured_Year" AS year FROM enriched WHERE "Occured_Year" IS NOT NULL'))
def published_years(spark, d):
    """The table's years, from its manifest."""
    return layout.manifest(spark, B.published(spark, d)).select("year").where("year IS NOT NULL").distinct()
