"""Queries answered by the stored count cube: the reports under the choices of
the interactive report (F1) and under its defaults (F3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import cube as Q
from . import frames as B
from .catalog import (
    _DEFAULT_VIEW,
    _F_WHERE,
    _FILTERS,
    _PROFILE_COLS,
    _count_sql,
    _flag_sql,
    _profile_sql,
    SUMMARIES,
    TOP_N,
    r6,
    register,
)
from .oracle import q

_REPORTS: dict[str, Callable[..., DataFrame]] = {
    "by_year": lambda c, **o: Q.count_by(c, "Occured_Year", **o),
    "by_month": lambda c, **o: Q.count_by(c, "Occured_Month", **o),
    "by_hour": lambda c, **o: Q.count_by(c, "Hour", **o),
    "top_crimes": lambda c, **o: Q.top_counts(c, "Crm_Cd_Desc", TOP_N, **o),
    "by_descent": lambda c, **o: Q.count_by(c, "Vict_Descent", **o),
    "mean_age_by_crime": lambda c, **o: r6(Q.mean_age_by(c, "Crm_Cd_Desc", TOP_N, "avg_victim_age", **o), "avg_victim_age"),
    "top_areas": lambda c, **o: Q.top_counts(c, "AREA_NAME", TOP_N, **o),
    "top_premises": lambda c, **o: Q.top_counts(c, "Premis_Desc", TOP_N, **o),
    "weapon_split": lambda c, **o: Q.count_by(c, "Has_Weapon", **o),
    "top_weapons": lambda c, **o: Q.top_counts(c, "Weapon_Desc", TOP_N, known=True, **o),
    "weapon_share": lambda c, **o: r6(Q.share_by(c, "Has_Weapon", **o), "pct"),
    "by_region": lambda c, **o: Q.count_by(c, "spa", **o),
    "top_region_crimes": lambda c, **o: Q.top_counts(c, ["spa", "Crm_Cd_Desc"], 20, **o),
    "income_vs_count": lambda c, **o: r6(Q.income_vs_count(c, **o), "avg_income"),
    "by_year_region": lambda c, **o: Q.count_by(c, ["Occured_Year", "spa"], **o),
    "region_series": lambda c, **o: Q.series_by(c, "spa", "Occured_Year", **o),
    "weapon_by_region": lambda c, **o: Q.count_by(c, ["spa", "Has_Weapon"], **o),
    "weapon_pivot": lambda c, **o: Q.pivot_counts(c, "spa", "Has_Weapon", ["No", "Yes"], **o),
    "region_profile": lambda c, **o: r6(Q.region_profile(c, **o), *_PROFILE_COLS[1:]),
    "region_month_panel": lambda c, **o: r6(Q.region_month_panel(c, **o), *_PROFILE_COLS[1:]),
}


def _chosen(t: str) -> str:
    return f"(SELECT * FROM {t} WHERE {_F_WHERE})"


def _add(name: str, report: Callable[..., DataFrame], sql: Callable[[str], str]) -> None:
    register(f"cube_{name}", q(sql(_chosen("enriched"))))(lambda spark, d: report(B.stored_cube(spark, d), **_FILTERS))
    register(f"cube_{name}_fanout", q(sql(_chosen("enriched_fanout"))))(
        lambda spark, d: report(B.stored_cube(spark, d), fanout=True, **_FILTERS))


for _name, _, _sql in SUMMARIES:
    _add(_name, _REPORTS[_name], _sql)


@register("cube_filtered_count", q(f"SELECT count(*) AS n_rows FROM {_chosen('enriched')}"))
def cube_filtered_count(spark, d):
    return Q.filtered_count(B.stored_cube(spark, d), **_FILTERS)


@register("cube_selected_regions", q("SELECT count(DISTINCT spa) AS n_regions FROM enriched"))
def cube_selected_regions(spark, d):
    return Q.selected_regions(B.stored_cube(spark, d))


# Under the report's defaults; the years and months come from the cube too.

@register("cube_view_top_crimes", q(_count_sql(_DEFAULT_VIEW, ["Crm_Cd_Desc"], TOP_N)))
def cube_view_top_crimes(spark, d):
    cube = B.stored_cube(spark, d)
    return Q.top_counts(cube, "Crm_Cd_Desc", TOP_N, **cube.defaults())


@register("cube_view_weapon_by_region", q(_count_sql(_flag_sql(_DEFAULT_VIEW), ["spa", "Has_Weapon"])))
def cube_view_weapon_by_region(spark, d):
    cube = B.stored_cube(spark, d)
    return Q.count_by(cube, ["spa", "Has_Weapon"], **cube.defaults())


@register("cube_view_region_profile", q(_profile_sql(_DEFAULT_VIEW, ["spa"])))
def cube_view_region_profile(spark, d):
    cube = B.stored_cube(spark, d)
    return r6(Q.region_profile(cube, **cube.defaults()), *_PROFILE_COLS[1:])
