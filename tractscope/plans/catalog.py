"""Registered queries: name -> (Spark callable, DuckDB oracle SQL or None).

Each Spark callable takes ``(spark, sf_dir)`` and returns a lazy
DataFrame over the whole test tables.  Float columns that come from
aggregation or trigonometry are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import enrich as J
from ..operators import filters as FL
from ..operators import model as M
from ..operators import profile as P
from ..operators import rank as R
from ..operators import spatial as G
from ..operators import summary as A
from ..session import reliable_checkpoint
from . import frames as B
from .flagship import flagship as _flagship
from .oracle import grid_i, haversine_sql, hex_sql, in_list, lit, q

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}

# Fixed parameters of the registered queries (stand-ins where the source's
# values have no rows in the test tables).
PICK_REGIONS = ("SPA 4 - Metro", "SPA 6 - South")
PICK_YEARS = (1996, 1997, 1998)
PICK_MONTHS = (1, 2, 3, 12)
BOX = (34.00, 34.08, -118.30, -118.20)
CENTER = (34.0522, -118.2437)
RADIUS_KM = 2.0
NEAREST_KM, NEAREST_N = 10.0, 250
MONTH_PICK = (1997, 7)
SCALE = 500
HEX_GRIDSIZE = 80
HEX_EXTENT = (-118.7, -118.15, 33.7, 34.35)
TOP_N = 10


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = (fn, sql)
        return fn
    return deco


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


def _sel(cols: list[str]) -> str:
    return ", ".join(f'"{c}"' for c in cols)


# ============================================================ profile (P)

@register("scan_incidents", q('SELECT * FROM raw_incident'))
def scan_incidents(spark, d):
    return B.raw_incidents(spark, d)


@register("table_shape", q('SELECT count(*) AS n_rows, CAST(20 AS INTEGER) AS n_cols FROM clean_incident'))
def table_shape(spark, d):
    return P.table_shape(B.clean(spark, d))


@register("preview", q('SELECT * FROM clean_incident ORDER BY "DR_NO" LIMIT 20'))
def preview(spark, d):
    return P.preview(B.clean(spark, d), 20)


def _null_profile_sql(table: str, cols: list[str]) -> str:
    parts = [
        f"SELECT {lit(c)} AS column_name, count(*) - count(\"{c}\") AS null_count, "
        f"round(100.0::DOUBLE * (count(*) - count(\"{c}\")) / count(*), 6) AS null_pct FROM {table}"
        for c in cols
    ]
    return q(" UNION ALL ".join(parts))


TRACT_RAW_COLS = ["tract", "spa", "med_hh_income", "ami_category", "med_hh_income_text"]


@register("null_profile", _null_profile_sql("raw_tract", TRACT_RAW_COLS))
def null_profile(spark, d):
    return r6(P.null_profile(B.raw_tracts(spark, d)), "null_pct")


@register("value_counts_ami", q("SELECT ami_category, count(*) AS count FROM raw_tract "
                                "WHERE ami_category IS NOT NULL GROUP BY ami_category"))
def value_counts_ami(spark, d):
    return P.value_counts(B.raw_tracts(spark, d), "ami_category")


@register("distinct_regions", q("SELECT DISTINCT spa FROM region_incident WHERE spa IS NOT NULL"))
def distinct_regions(spark, d):
    return P.distinct_values(B.regioned(spark, d), "spa")


@register("imputed_sample", q("SELECT tract, spa, round(med_hh_income, 6) AS med_hh_income, ami_category, "
                              "med_hh_income_text, was_imputed FROM imputed_tract WHERE was_imputed "
                              "ORDER BY tract LIMIT 20"))
def imputed_sample(spark, d):
    return r6(P.imputed_sample(B.raw_tracts(spark, d), 20), "med_hh_income")


@register("null_profile_after", _null_profile_sql(
    "(SELECT tract, spa, med_hh_income, ami_category, med_hh_income_text FROM imputed_tract)", TRACT_RAW_COLS))
def null_profile_after(spark, d):
    return r6(P.null_profile(C.impute_income(B.raw_tracts(spark, d))), "null_pct")


# ============================================================ cleaning (C)

@register("rename_columns", q("SELECT * FROM renamed"))
def rename_columns(spark, d):
    return B.renamed(spark, d)


@register("parse_dates", q('SELECT "DR_NO", "DATE_OCC", "Date_Rptd", "Date_Occured", "Date_Reported" FROM dated'))
def parse_dates(spark, d):
    return C.parse_dates(B.renamed(spark, d)).select("DR_NO", "DATE_OCC", "Date_Rptd", "Date_Occured", "Date_Reported")


@register("date_parts_occurred", q('SELECT "DR_NO", CAST(year("Date_Occured") AS INTEGER) AS "Occured_Year", '
                                   'CAST(month("Date_Occured") AS INTEGER) AS "Occured_Month", '
                                   'CAST(day("Date_Occured") AS INTEGER) AS "Occured_Day" FROM dated'))
def date_parts_occurred(spark, d):
    df = C.add_date_parts(C.parse_dates(B.renamed(spark, d)), "Date_Occured", "Occured")
    return df.select("DR_NO", "Occured_Year", "Occured_Month", "Occured_Day")


@register("date_parts_reported", q('SELECT "DR_NO", CAST(year("Date_Reported") AS INTEGER) AS "Reported_Year", '
                                   'CAST(month("Date_Reported") AS INTEGER) AS "Reported_Month", '
                                   'CAST(day("Date_Reported") AS INTEGER) AS "Reported_Day" FROM dated'))
def date_parts_reported(spark, d):
    df = C.add_date_parts(C.parse_dates(B.renamed(spark, d)), "Date_Reported", "Reported")
    return df.select("DR_NO", "Reported_Year", "Reported_Month", "Reported_Day")


@register("hour_of_day", q('SELECT "DR_NO", "TIME_OCC", CAST("TIME_OCC" // 100 AS INTEGER) AS "Hour" FROM renamed'))
def hour_of_day(spark, d):
    return C.add_hour(B.renamed(spark, d)).select("DR_NO", "TIME_OCC", "Hour")


@register("weapon_flag", q('SELECT "DR_NO", "Weapon_Used_Cd", CASE WHEN "Weapon_Used_Cd" IS NOT NULL '
                           'THEN \'Yes\' ELSE \'No\' END AS "Weapon_Used" FROM renamed'))
def weapon_flag(spark, d):
    return C.add_weapon_flag(B.renamed(spark, d)).select("DR_NO", "Weapon_Used_Cd", "Weapon_Used")


@register("drop_zero_coords", q('SELECT "DR_NO", "LAT", "LON" FROM renamed WHERE "LAT" != 0 AND "LON" != 0'))
def drop_zero_coords(spark, d):
    return C.drop_zero_coords(B.renamed(spark, d)).select("DR_NO", "LAT", "LON")


@register("drop_invalid_age", q('SELECT "DR_NO", "Vict_Age" FROM renamed WHERE "Vict_Age" > 0'))
def drop_invalid_age(spark, d):
    return C.drop_invalid_age(B.renamed(spark, d)).select("DR_NO", "Vict_Age")


@register("parse_money", q("SELECT tract, med_hh_income_text, TRY_CAST(regexp_replace(med_hh_income_text, "
                           "'[$,\\s]', '', 'g') AS DOUBLE) AS med_hh_income_num FROM raw_tract"))
def parse_money(spark, d):
    from ..functions import parse_money as pm
    return B.raw_tracts(spark, d).select("tract", "med_hh_income_text",
                                         pm("med_hh_income_text").alias("med_hh_income_num"))


@register("impute_income", q("SELECT tract, round(med_hh_income, 6) AS med_hh_income, ami_category FROM imputed_tract"))
def impute_income(spark, d):
    return r6(C.impute_income(B.raw_tracts(spark, d)).select("tract", "med_hh_income", "ami_category"),
              "med_hh_income")


@register("tract_to_string", q("SELECT CAST(tract AS VARCHAR) AS tract, spa FROM raw_tract"))
def tract_to_string(spark, d):
    return C.tract_to_string(B.raw_tracts(spark, d)).select("tract", "spa")


@register("trim_region", q("SELECT tract, regexp_replace(spa, '^\\s+|\\s+$', '', 'g') AS spa FROM raw_tract"))
def trim_region(spark, d):
    return C.trim_region(B.raw_tracts(spark, d)).select("tract", "spa")


@register("valid_geo", q(f'SELECT "DR_NO", CAST("LAT" AS DOUBLE) AS "LAT_d", CAST("LON" AS DOUBLE) AS "LON_d" '
                         f'FROM clean_incident WHERE "LAT" BETWEEN 33.5 AND 34.5 AND "LON" BETWEEN -119.0 AND -117.0'))
def valid_geo(spark, d):
    return C.valid_geo(B.clean(spark, d)).select("DR_NO", "LAT_d", "LON_d")


@register("geo_flag", q('SELECT "DR_NO", CASE WHEN "LAT" BETWEEN 33.5 AND 34.5 AND "LON" BETWEEN -119.0 AND -117.0 '
                        'THEN 1 ELSE 0 END AS geo_valid FROM renamed'))
def geo_flag(spark, d):
    return C.geo_flag(B.renamed(spark, d)).select("DR_NO", "geo_valid")


@register("area_to_region", q('SELECT "DR_NO", "AREA_NAME", spa FROM region_incident'))
def area_to_region(spark, d):
    return B.regioned(spark, d).select("DR_NO", "AREA_NAME", "spa")


@register("day_part", q('SELECT "DR_NO", "Hour", CASE WHEN "Hour" >= 6 AND "Hour" < 18 THEN \'Day\' '
                        'ELSE \'Night\' END AS day_part FROM clean_incident'))
def day_part(spark, d):
    return C.add_day_part(B.clean(spark, d)).select("DR_NO", "Hour", "day_part")


_NN_COLS = ["DR_NO", "spa", "med_hh_income", "ami_category", "Vict_Descent", "Weapon_Desc"]


@register("drop_nulls", q('SELECT "DR_NO", spa, round(med_hh_income, 6) AS med_hh_income, ami_category, '
                          '"Vict_Descent", "Weapon_Desc" FROM enriched WHERE ' +
                          " AND ".join(f'"{c}" IS NOT NULL' for c in _NN_COLS)))
def drop_nulls(spark, d):
    return r6(C.drop_nulls(B.enriched(spark, d).select(*_NN_COLS)), "med_hh_income")


@register("region_not_null", q('SELECT "DR_NO", spa FROM enriched WHERE spa IS NOT NULL'))
def region_not_null(spark, d):
    return C.region_not_null(B.enriched(spark, d)).select("DR_NO", "spa")


@register("clean_incidents", q("SELECT * FROM clean_incident"))
def clean_incidents(spark, d):
    return B.clean(spark, d)


@register("clean_tracts", q("SELECT tract, spa, round(med_hh_income, 6) AS med_hh_income, ami_category, "
                            "med_hh_income_text FROM clean_tract"))
def clean_tracts(spark, d):
    return r6(B.tracts(spark, d), "med_hh_income")


# ============================================================ filters (F)

_F_WHERE = (f"spa IN {in_list(PICK_REGIONS)} AND \"Occured_Year\" IN {in_list(PICK_YEARS)} "
            f"AND \"Occured_Month\" IN {in_list(PICK_MONTHS)}")
_FILTERS = dict(regions=PICK_REGIONS, years=PICK_YEARS, months=PICK_MONTHS)
_LATEST = ('"Occured_Year" IN (SELECT DISTINCT "Occured_Year" FROM enriched WHERE "Occured_Year" IS NOT NULL '
           'ORDER BY 1 DESC LIMIT 3)')


@register("filter_multi", q(f'SELECT "DR_NO", spa, "Occured_Year", "Occured_Month" FROM enriched WHERE {_F_WHERE}'))
def filter_multi(spark, d):
    return FL.apply_filters(B.enriched(spark, d), **_FILTERS).select("DR_NO", "spa", "Occured_Year", "Occured_Month")


@register("filter_latest_years", q(f'SELECT "DR_NO", "Occured_Year" FROM enriched WHERE {_LATEST}'))
def filter_latest_years(spark, d):
    return FL.filter_latest_years(B.enriched(spark, d)).select("DR_NO", "Occured_Year")


@register("filter_defaults", q(f'SELECT "DR_NO", spa, "Occured_Year", "Occured_Month" FROM enriched '
                               f'WHERE {_LATEST} AND "Occured_Month" IS NOT NULL'))
def filter_defaults(spark, d):
    return FL.filter_defaults(B.enriched(spark, d)).select("DR_NO", "spa", "Occured_Year", "Occured_Month")


@register("filtered_count", q(f"SELECT count(*) AS n_rows FROM enriched WHERE {_F_WHERE}"))
def filtered_count(spark, d):
    return FL.filtered_count(B.enriched(spark, d), **_FILTERS)


@register("selected_regions", q("SELECT count(DISTINCT spa) AS n_regions FROM enriched"))
def selected_regions(spark, d):
    return FL.selected_regions(B.enriched(spark, d))


# ============================================================ joins (J)

@register("enrich_fanout", q('SELECT "DR_NO", spa, round(med_hh_income, 6) AS med_hh_income, ami_category '
                             'FROM enriched_fanout'))
def enrich_fanout(spark, d):
    return r6(B.enriched_fanout(spark, d).select("DR_NO", "spa", "med_hh_income", "ami_category"), "med_hh_income")


@register("enrich_region", q('SELECT "DR_NO", spa, round(med_hh_income, 6) AS med_hh_income, ami_category '
                             'FROM enriched'))
def enrich_region(spark, d):
    return r6(B.enriched(spark, d).select("DR_NO", "spa", "med_hh_income", "ami_category"), "med_hh_income")


# ============================================================ summaries (A)
# Each report over the merged table is registered twice: on the default
# join (J1b) and, with a ``_fanout`` suffix, on the parity join.

def _flag(df: DataFrame) -> DataFrame:
    return C.add_weapon_flag(df, out="Has_Weapon")


def _flag_sql(t: str) -> str:
    return f'(SELECT *, CASE WHEN "Weapon_Used_Cd" IS NOT NULL THEN \'Yes\' ELSE \'No\' END AS "Has_Weapon" FROM {t})'


def _count_sql(t: str, keys: list[str], n: int | None = None) -> str:
    ks = _sel(keys)
    sql = f"SELECT {ks}, count(*) AS count FROM {t} GROUP BY {ks}"
    if n is not None:
        order = ", ".join(f'"{k}" NULLS LAST' for k in keys)
        sql += f" ORDER BY count DESC, {order} LIMIT {n}"
    return sql


_MEASURES_SQL = ("count(*) AS crime_count, avg(med_hh_income) AS avg_income, avg(\"Vict_Age\") AS avg_victim_age, "
                 "avg(CASE WHEN \"Weapon_Used_Cd\" IS NOT NULL THEN 1 ELSE 0 END) AS weapon_rate")
_PROFILE_COLS = ["crime_count", "avg_income", "avg_victim_age", "weapon_rate"]


def _profile_sql(t: str, keys: list[str], rounded: bool = True) -> str:
    ks = _sel(keys)
    inner = (f"SELECT {ks}, {_MEASURES_SQL} FROM {t} WHERE spa IS NOT NULL GROUP BY {ks}")
    cols = ks + ", crime_count, " + ", ".join(
        f"round({c}, 6) AS {c}" if rounded else c for c in _PROFILE_COLS[1:])
    return (f"SELECT {cols} FROM ({inner}) WHERE " +
            " AND ".join(f'"{c}" IS NOT NULL' for c in keys + _PROFILE_COLS))


W = J.FANOUT_WEIGHT  # multiplicity column of the weighted fan-out frame

SUMMARIES: list[tuple[str, Callable[..., DataFrame], Callable[[str], str]]] = [
    ("by_year", lambda df, w=None: A.count_by(df, "Occured_Year", weight=w),
     lambda t: _count_sql(t, ["Occured_Year"])),
    ("by_month", lambda df, w=None: A.count_by(df, "Occured_Month", weight=w),
     lambda t: _count_sql(t, ["Occured_Month"])),
    ("by_hour", lambda df, w=None: A.count_by(df, "Hour", weight=w), lambda t: _count_sql(t, ["Hour"])),
    ("top_crimes", lambda df, w=None: A.top_counts(df, "Crm_Cd_Desc", TOP_N, weight=w),
     lambda t: _count_sql(t, ["Crm_Cd_Desc"], TOP_N)),
    ("by_descent", lambda df, w=None: A.count_by(df, "Vict_Descent", weight=w),
     lambda t: _count_sql(t, ["Vict_Descent"])),
    ("mean_age_by_crime",
     lambda df, w=None: r6(A.mean_by(df, "Crm_Cd_Desc", "Vict_Age", TOP_N, out="avg_victim_age", weight=w),
                           "avg_victim_age"),
     lambda t: (f'SELECT "Crm_Cd_Desc", round(avg("Vict_Age"), 6) AS avg_victim_age FROM {t} '
                f'GROUP BY "Crm_Cd_Desc" ORDER BY avg("Vict_Age") DESC NULLS LAST, "Crm_Cd_Desc" NULLS LAST '
                f'LIMIT {TOP_N}')),
    ("top_areas", lambda df, w=None: A.top_counts(df, "AREA_NAME", TOP_N, weight=w),
     lambda t: _count_sql(t, ["AREA_NAME"], TOP_N)),
    ("top_premises", lambda df, w=None: A.top_counts(df, "Premis_Desc", TOP_N, weight=w),
     lambda t: _count_sql(t, ["Premis_Desc"], TOP_N)),
    ("weapon_split", lambda df, w=None: A.count_by(_flag(df), "Has_Weapon", weight=w),
     lambda t: _count_sql(_flag_sql(t), ["Has_Weapon"])),
    ("top_weapons",
     lambda df, w=None: A.top_counts(df.filter(F.col("Weapon_Desc").isNotNull()), "Weapon_Desc", TOP_N, weight=w),
     lambda t: _count_sql(f'(SELECT * FROM {t} WHERE "Weapon_Desc" IS NOT NULL)', ["Weapon_Desc"], TOP_N)),
    ("weapon_share", lambda df, w=None: r6(A.share_by(_flag(df), "Has_Weapon", weight=w), "pct"),
     lambda t: (f'SELECT "Has_Weapon", count(*) AS count, '
                f'round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct '
                f'FROM {_flag_sql(t)} GROUP BY "Has_Weapon"')),
    ("by_region", lambda df, w=None: A.count_by(df, "spa", weight=w), lambda t: _count_sql(t, ["spa"])),
    ("top_region_crimes", lambda df, w=None: A.top_counts(df, ["spa", "Crm_Cd_Desc"], 20, weight=w),
     lambda t: _count_sql(t, ["spa", "Crm_Cd_Desc"], 20)),
    ("income_vs_count", lambda df, w=None: r6(A.income_vs_count(df, weight=w), "avg_income"),
     lambda t: f"SELECT spa, round(avg(med_hh_income), 6) AS avg_income, count(*) AS crime_count FROM {t} GROUP BY spa"),
    ("by_year_region", lambda df, w=None: A.count_by(df, ["Occured_Year", "spa"], weight=w),
     lambda t: _count_sql(t, ["Occured_Year", "spa"])),
    ("region_series", lambda df, w=None: A.series_by(df, "spa", "Occured_Year", weight=w),
     lambda t: (f'SELECT spa, "Occured_Year", count(*) AS count, CAST(row_number() OVER '
                f'(PARTITION BY spa ORDER BY "Occured_Year" NULLS LAST) AS INTEGER) AS step '
                f'FROM {t} GROUP BY spa, "Occured_Year"')),
    ("weapon_by_region", lambda df, w=None: A.count_by(_flag(df), ["spa", "Has_Weapon"], weight=w),
     lambda t: _count_sql(_flag_sql(t), ["spa", "Has_Weapon"])),
    ("weapon_pivot", lambda df, w=None: A.pivot_counts(_flag(df), "spa", "Has_Weapon", ["No", "Yes"], weight=w),
     lambda t: (f'SELECT spa, NULLIF(count(*) FILTER (WHERE "Has_Weapon" = \'No\'), 0) AS "No", '
                f'NULLIF(count(*) FILTER (WHERE "Has_Weapon" = \'Yes\'), 0) AS "Yes" '
                f'FROM {_flag_sql(t)} GROUP BY spa')),
    ("region_profile", lambda df, w=None: r6(A.region_profile(df, weight=w), *_PROFILE_COLS[1:]),
     lambda t: _profile_sql(t, ["spa"])),
    ("region_month_panel", lambda df, w=None: r6(A.region_month_panel(df, weight=w), *_PROFILE_COLS[1:]),
     lambda t: _profile_sql(t, ["spa", "Occured_Year", "Occured_Month"])),
]


def _summary_query(base: Callable[[SparkSession, str], DataFrame], op, weight: str | None = None) -> Query:
    return lambda spark, d: op(base(spark, d), weight)


# J1b reports; the _fanout twins read the weighted J1 frame (same answers as
# aggregating the row-multiplied join, which the oracle does literally).
for _name, _op, _sql in SUMMARIES:
    register(_name, q(_sql("enriched")))(_summary_query(B.enriched, _op))
for _name, _op, _sql in SUMMARIES:
    register(_name + "_fanout", q(_sql("enriched_fanout")))(_summary_query(B.enriched_weighted, _op, W))


@register("mean_income_by_region", q("SELECT spa, round(avg(med_hh_income), 6) AS avg_income FROM raw_tract "
                                     "WHERE spa IS NOT NULL GROUP BY spa"))
def mean_income_by_region(spark, d):
    t = B.raw_tracts(spark, d).filter(F.col("spa").isNotNull())
    return r6(A.mean_by(t, "spa", "med_hh_income", out="avg_income"), "avg_income")


@register("group_mean_income", q("SELECT round(avg(CASE WHEN ami_category = 'Low Income' THEN med_hh_income END), 6) "
                                 "AS low_income_mean FROM raw_tract"))
def group_mean_income(spark, d):
    t = B.raw_tracts(spark, d)
    return r6(t.agg(F.avg(F.when(F.col("ami_category") == "Low Income", F.col("med_hh_income")))
                    .alias("low_income_mean")), "low_income_mean")


def _cell_region_sql(src: str = "enriched") -> str:
    return (
        f"SELECT lat_i, lon_i, spa, count(*) AS n, lat_i / {SCALE} AS lat_grid, lon_i / {SCALE} AS lon_grid FROM ("
        f"SELECT {grid_i('CAST(\"LAT\" AS DOUBLE)', SCALE)} AS lat_i, "
        f"{grid_i('CAST(\"LON\" AS DOUBLE)', SCALE)} AS lon_i, "
        f"spa FROM {src}) WHERE lat_i IS NOT NULL AND lon_i IS NOT NULL AND spa IS NOT NULL "
        f"GROUP BY lat_i, lon_i, spa")


def _dominant_sql(src: str = "enriched") -> str:
    return (f"SELECT lat_i, lon_i, spa, n FROM (SELECT *, row_number() OVER (PARTITION BY lat_i, lon_i "
            f"ORDER BY n DESC, spa) AS rn FROM ({_cell_region_sql(src)})) WHERE rn = 1")


_DOMINANT_SQL = _dominant_sql()


@register("cell_region_counts", q(_cell_region_sql()))
def cell_region_counts(spark, d):
    return A.cell_region_counts(B.enriched(spark, d), SCALE)


def dominant_cells(spark, d) -> DataFrame:
    return R.top_one_per_group(A.cell_region_counts(B.enriched(spark, d), SCALE), ["lat_i", "lon_i"], "n", "spa")


@register("dominant_region_per_cell", q(_DOMINANT_SQL))
def dominant_region_per_cell(spark, d):
    return dominant_cells(spark, d)


# ============================================================ spatial (G)

_BOX_WHERE = (f'"LAT_d" BETWEEN {lit(BOX[0])} AND {lit(BOX[1])} AND "LON_d" BETWEEN {lit(BOX[2])} AND {lit(BOX[3])}')
_DIST = haversine_sql(*CENTER)


def _hot_sql(src: str, k: int | None = None, min_count: int | None = None) -> str:
    sql = (f"SELECT lat_i, lon_i, count(*) AS count, lat_i / {SCALE} AS lat_grid, lon_i / {SCALE} AS lon_grid "
           f"FROM (SELECT {grid_i('\"LAT_d\"', SCALE)} AS lat_i, {grid_i('\"LON_d\"', SCALE)} AS lon_i FROM {src}) "
           f"GROUP BY lat_i, lon_i")
    if min_count is not None:
        sql += f" HAVING count(*) >= {min_count}"
    if k is not None:
        sql += f" ORDER BY count DESC, lat_i, lon_i LIMIT {k}"
    return sql


@register("within_box", q(f'SELECT "DR_NO", "LAT_d", "LON_d", "Crm_Cd_Desc" FROM geo WHERE {_BOX_WHERE}'))
def within_box(spark, d):
    return G.within_box(B.geo(spark, d), *BOX).select("DR_NO", "LAT_d", "LON_d", "Crm_Cd_Desc")


@register("add_grid", q(f'SELECT "DR_NO", {grid_i(chr(34) + "LAT_d" + chr(34), SCALE)} AS lat_i, '
                        f'{grid_i(chr(34) + "LON_d" + chr(34), SCALE)} AS lon_i, '
                        f'floor("LAT_d" * {SCALE}) / {SCALE} AS lat_grid, floor("LON_d" * {SCALE}) / {SCALE} AS lon_grid '
                        f'FROM geo'))
def add_grid(spark, d):
    return G.add_grid(B.geo(spark, d), SCALE).select("DR_NO", "lat_i", "lon_i", "lat_grid", "lon_grid")


@register("hotspots_topk", q(_hot_sql("geo", 8000)))
def hotspots_topk(spark, d):
    return G.hotspots(B.geo(spark, d), SCALE, 8000)


@register("hotspots_min_count", q(_hot_sql("geo", None, 10)))
def hotspots_min_count(spark, d):
    return G.hotspots(B.geo(spark, d), SCALE, None, min_count=10)


def _day_night_sql(src: str = "geo") -> str:
    lat_i, lon_i = grid_i('"LAT_d"', SCALE), grid_i('"LON_d"', SCALE)
    return (
        f"SELECT day_part, lat_i, lon_i, count, lat_grid, lon_grid, rank FROM ("
        f"SELECT *, CAST(row_number() OVER (PARTITION BY day_part ORDER BY count DESC, lat_i, lon_i) AS INTEGER) "
        f"AS rank FROM (SELECT day_part, lat_i, lon_i, count(*) AS count, lat_i / {SCALE} AS lat_grid, "
        f"lon_i / {SCALE} AS lon_grid FROM (SELECT CASE WHEN \"Hour\" >= 6 AND \"Hour\" < 18 THEN 'Day' "
        f"ELSE 'Night' END AS day_part, {lat_i} AS lat_i, {lon_i} AS lon_i FROM {src}) "
        f"GROUP BY day_part, lat_i, lon_i)) WHERE rank <= 6000")


@register("hotspots_day_night", q(_day_night_sql()))
def hotspots_day_night(spark, d):
    return G.hotspots_by_part(B.geo(spark, d), SCALE, 6000)


@register("hotspots_month", q(_hot_sql(f'(SELECT * FROM geo WHERE "Occured_Year" = {MONTH_PICK[0]} '
                                       f'AND "Occured_Month" = {MONTH_PICK[1]})', 5000)))
def hotspots_month(spark, d):
    return G.hotspots(G.filter_month(B.geo(spark, d), *MONTH_PICK), SCALE, 5000)


@register("top_crimes_box", q(_count_sql(f"(SELECT * FROM geo WHERE {_BOX_WHERE})", ["Crm_Cd_Desc"], TOP_N)))
def top_crimes_box(spark, d):
    return A.top_counts(G.within_box(B.geo(spark, d), *BOX), "Crm_Cd_Desc", TOP_N)


@register("haversine", q(f'SELECT "DR_NO", round({_DIST}, 6) AS dist_km FROM geo'))
def haversine(spark, d):
    return r6(G.add_distance(B.geo(spark, d), *CENTER).select("DR_NO", "dist_km"), "dist_km")


def _near_src(src: str = "geo") -> str:
    return f"(SELECT *, {_DIST} AS dist_km FROM {src})"


_NEAR_SRC = _near_src()


@register("within_radius", q(f'SELECT "DR_NO", "LAT_d", "LON_d", round(dist_km, 6) AS dist_km FROM {_NEAR_SRC} '
                             f'WHERE dist_km <= {lit(RADIUS_KM)}'))
def within_radius(spark, d):
    return r6(G.within_radius(B.geo(spark, d), *CENTER, RADIUS_KM).select("DR_NO", "LAT_d", "LON_d", "dist_km"),
              "dist_km")


@register("nearest", q(f'SELECT "DR_NO", "LAT_d", "LON_d", "Crm_Cd_Desc", round(dist_km, 6) AS dist_km '
                       f'FROM {_NEAR_SRC} WHERE dist_km <= {lit(NEAREST_KM)} ORDER BY dist_km, "DR_NO" '
                       f'LIMIT {NEAREST_N}'))
def nearest(spark, d):
    near = G.nearest(B.geo(spark, d), *CENTER, NEAREST_KM, NEAREST_N)
    return r6(near.select("DR_NO", "LAT_d", "LON_d", "Crm_Cd_Desc", "dist_km"), "dist_km")


@register("top_crimes_radius", q(_count_sql(f"(SELECT * FROM {_NEAR_SRC} WHERE dist_km <= {lit(RADIUS_KM)})",
                                            ["Crm_Cd_Desc"], TOP_N)))
def top_crimes_radius(spark, d):
    return A.top_counts(G.within_radius(B.geo(spark, d), *CENTER, RADIUS_KM), "Crm_Cd_Desc", TOP_N)


def _hexbin_sql(src: str = "geo") -> str:
    h = hex_sql('"LON_d"', '"LAT_d"', HEX_GRIDSIZE, HEX_EXTENT)
    inner = (f"SELECT {h['lattice']} AS hex_lattice, {h['col']} AS hex_col, {h['row']} AS hex_row, "
             f"{h['inside']} AS hex_inside FROM {src}")
    return (f"SELECT hex_lattice, hex_col, hex_row, count(*) AS count, "
            f"round({h['cx']('hex_lattice', 'hex_col')}, 6) AS hex_x, "
            f"round({h['cy']('hex_lattice', 'hex_row')}, 6) AS hex_y "
            f"FROM ({inner}) WHERE hex_inside GROUP BY hex_lattice, hex_col, hex_row")


@register("hexbin", q(_hexbin_sql()))
def hexbin(spark, d):
    return r6(G.hexbin(B.geo(spark, d), HEX_GRIDSIZE, HEX_EXTENT), "hex_x", "hex_y")


@register("cell_weight", q(f"SELECT *, round(ln(1 + count), 6) AS weight, CAST(count AS DOUBLE) AS weight_raw "
                           f"FROM ({_hot_sql('geo', 8000)})"))
def cell_weight(spark, d):
    cells = G.add_weight(G.hotspots(B.geo(spark, d), SCALE, 8000))
    return r6(G.add_weight(cells, use_log=False, out="weight_raw"), "weight")


@register("marker_size", q(f"SELECT *, round(10.0::DOUBLE * ln(1 + count), 6) AS size_log10, "
                           f"round(8.0::DOUBLE * ln(1 + count), 6) AS size_log8, round(sqrt(count), 6) AS size_sqrt "
                           f"FROM ({_hot_sql('geo', 8000)})"))
def marker_size(spark, d):
    cells = G.hotspots(B.geo(spark, d), SCALE, 8000)
    for kind in ("log10", "log8", "sqrt"):
        cells = G.marker_size(cells, kind, out=f"size_{kind}")
    return r6(cells, "size_log10", "size_log8", "size_sqrt")


_SHARE_SQL = ("(('0x' || substr(md5(concat_ws('|', '42', CAST(\"DR_NO\" AS VARCHAR))), 1, 8))::BIGINT / 4294967296.0::DOUBLE)")


@register("stable_sample", q(f'SELECT "DR_NO", "LON_d", "LAT_d" FROM geo WHERE {_SHARE_SQL} < 0.2'))
def stable_sample(spark, d):
    return G.stable_sample(B.geo(spark, d).select("DR_NO", "LON_d", "LAT_d"), "DR_NO", 0.2, 42)


@register("stable_sample_radius", q(f'SELECT "DR_NO", round(dist_km, 6) AS dist_km FROM {_NEAR_SRC} '
                                    f'WHERE dist_km <= {lit(NEAREST_KM)} AND {_SHARE_SQL} < 0.2'))
def stable_sample_radius(spark, d):
    near = G.within_radius(B.geo(spark, d), *CENTER, NEAREST_KM)
    return r6(G.stable_sample(near, "DR_NO", 0.2, 42).select("DR_NO", "dist_km"), "dist_km")


@register("map_points", q('SELECT "DR_NO", "LAT", "LON", "Crm_Cd_Desc" FROM clean_incident WHERE "LAT" != 0'))
def map_points(spark, d):
    return G.map_points(B.clean(spark, d))


@register("map_points_box", q(f'SELECT "DR_NO", "LAT", "LON", "Crm_Cd_Desc" FROM geo WHERE "LAT" != 0 AND {_BOX_WHERE}'))
def map_points_box(spark, d):
    """Every known point of the box."""
    return G.map_points(G.within_box(B.geo(spark, d), *BOX))


@register("marker_label", q(f"SELECT \"DR_NO\", substring(coalesce(\"Crm_Cd_Desc\", ''), 1, 80) AS label_box, "
                            f"printf('%s | %.2f km', substring(coalesce(\"Crm_Cd_Desc\", ''), 1, 60), dist_km) "
                            f"AS label_radius FROM {_NEAR_SRC} WHERE dist_km <= {lit(RADIUS_KM)}"))
def marker_label(spark, d):
    near = G.within_radius(B.geo(spark, d), *CENTER, RADIUS_KM)
    near = G.marker_label(near, out="label_box")
    near = G.marker_label(near, dist="dist_km", out="label_radius")
    return near.select("DR_NO", "label_box", "label_radius")


# ============================================================ statistics and ML (M), exact part


# Fixed cluster centers (lat, lon) for the exact k-means assignment step.
FIXED_CENTERS = [
    (33.72, -118.68), (33.80, -118.60), (33.90, -118.50), (34.00, -118.40),
    (34.10, -118.30), (34.20, -118.25), (34.30, -118.20), (33.75, -118.30),
]
PANEL_KEYS = ["spa", "Occured_Year", "Occured_Month"]
CLUSTER_K = 20000


def cluster_input_frame(spark, d) -> DataFrame:
    return G.hotspots(B.geo(spark, d).select("LAT_d", "LON_d").na.drop(), SCALE, CLUSTER_K)


def fixed_pred(spark, d) -> DataFrame:
    return M.assign_nearest(cluster_input_frame(spark, d), FIXED_CENTERS)


def labelled_cells(spark, d, weight: str | None = None) -> DataFrame:
    # cells and their dominant region from one scan (same rows as the J2 path)
    frame = B.enriched_weighted(spark, d) if weight else B.enriched(spark, d)
    return M.assign_nearest(G.hotspots_with_region(frame, SCALE, CLUSTER_K, weight), FIXED_CENTERS)


_CLUSTER_INPUT_SQL = _hot_sql('(SELECT "LAT_d", "LON_d" FROM geo WHERE "LAT_d" IS NOT NULL AND "LON_d" IS NOT NULL)',
                              CLUSTER_K)
_D2 = ", ".join(
    f"(lat_grid - {lit(a)}) * (lat_grid - {lit(a)}) + (lon_grid - {lit(b)}) * (lon_grid - {lit(b)})"
    for a, b in FIXED_CENTERS)
_FIXED_PRED_SQL = (f"SELECT *, CAST(list_position([{_D2}], list_min([{_D2}])) - 1 AS INTEGER) AS prediction "
                   f"FROM ({_CLUSTER_INPUT_SQL})")
_LABELLED_SQL = (f"SELECT p.*, dm.spa FROM ({_FIXED_PRED_SQL}) p LEFT JOIN ({_DOMINANT_SQL}) dm "
                 f"ON p.lat_i = dm.lat_i AND p.lon_i = dm.lon_i")
_CLUSTER_REGION_SQL = (f"SELECT prediction, spa AS cell_spa, CAST(sum(count) AS BIGINT) AS spa_crimes "
                       f"FROM ({_LABELLED_SQL}) GROUP BY prediction, spa")


def _corr_cte(src: str = "enriched") -> str:
    parts = [f"stddev_pop(CAST({c} AS DOUBLE)) AS sd_{c}" for c in _PROFILE_COLS]
    parts += [f"covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS cv_{a}_{b}"
              for i, a in enumerate(_PROFILE_COLS) for b in _PROFILE_COLS[i:]]
    return f", m AS (SELECT {', '.join(parts)} FROM ({_profile_sql(src, ['spa'], rounded=False)}))"


def _corr_cell(a: str, b: str) -> str:
    if a == b:
        r = f"CASE WHEN sd_{a} = 0 THEN 'NaN'::DOUBLE ELSE 1.0::DOUBLE END"
    else:
        lo, hi = sorted((a, b), key=_PROFILE_COLS.index)
        r = f"round(CASE WHEN sd_{a} * sd_{b} = 0 THEN 'NaN'::DOUBLE ELSE cv_{lo}_{hi} / (sd_{a} * sd_{b}) END, 6)"
    return f"SELECT {lit(a)} AS feature_a, {lit(b)} AS feature_b, {r} AS r FROM m"


@register("correlation_long", q(" UNION ALL ".join(_corr_cell(a, b) for a in _PROFILE_COLS for b in _PROFILE_COLS),
                                _corr_cte()))
def correlation_long(spark, d):
    return r6(M.correlation_long(A.region_profile(B.enriched(spark, d)), _PROFILE_COLS), "r")


_SPLIT_SQL = ("CASE WHEN ('0x' || substr(md5(concat_ws('|', '42', spa, CAST(\"Occured_Year\" AS VARCHAR), "
              "CAST(\"Occured_Month\" AS VARCHAR))), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.8 THEN 'train' ELSE 'test' END")


@register("split_by_key", q(f'SELECT spa, "Occured_Year", "Occured_Month", {_SPLIT_SQL} AS split '
                            f'FROM ({_profile_sql("enriched", PANEL_KEYS, rounded=False)})'))
def split_by_key(spark, d):
    panel = A.region_month_panel(B.enriched(spark, d))
    return M.assign_split(panel, PANEL_KEYS).select(*PANEL_KEYS, "split")


_FIXED_REG_SQL = (
    f"SELECT n, round(sqrt(sse / n), 6) AS rmse, round(1.0::DOUBLE - sse / (var * n), 6) AS r2 FROM ("
    f"SELECT count(*) AS n, sum((y - p) * (y - p)) AS sse, var_pop(y) AS var FROM ("
    f"SELECT CAST(crime_count AS DOUBLE) AS y, avg_victim_age * 2.0::DOUBLE + weapon_rate * 50.0::DOUBLE AS p "
    f"FROM ({_profile_sql('enriched', PANEL_KEYS, rounded=False)}) WHERE {_SPLIT_SQL} = 'test'))")


@register("regression_metrics_fixed", q(_FIXED_REG_SQL))
def regression_metrics_fixed(spark, d):
    _, test = M.split_by_key(A.region_month_panel(B.enriched(spark, d)), PANEL_KEYS)
    pred = test.withColumn("prediction", F.col("avg_victim_age") * F.lit(2.0) + F.col("weapon_rate") * F.lit(50.0))
    return r6(M.regression_metrics(pred), "rmse", "r2")


@register("cluster_input", q(_CLUSTER_INPUT_SQL))
def cluster_input(spark, d):
    return cluster_input_frame(spark, d)


@register("assign_nearest", q(_FIXED_PRED_SQL))
def assign_nearest(spark, d):
    return fixed_pred(spark, d)


@register("label_cells", q(_LABELLED_SQL))
def label_cells(spark, d):
    return labelled_cells(spark, d)


@register("cluster_summary_fixed", q(
    f"SELECT prediction, count(*) AS num_cells, CAST(sum(count) AS BIGINT) AS total_crimes_in_cells, "
    f"round(avg(lat_grid), 6) AS center_lat, round(avg(lon_grid), 6) AS center_lon "
    f"FROM ({_FIXED_PRED_SQL}) GROUP BY prediction"))
def cluster_summary_fixed(spark, d):
    return r6(M.cluster_summary(fixed_pred(spark, d)), "center_lat", "center_lon")


@register("cluster_totals_fixed", q(f"SELECT prediction, CAST(sum(count) AS BIGINT) AS total_crimes "
                                    f"FROM ({_FIXED_PRED_SQL}) GROUP BY prediction"))
def cluster_totals_fixed(spark, d):
    return M.cluster_totals(fixed_pred(spark, d))


def _cluster_region(spark, d) -> DataFrame:
    return M.cluster_region_totals(labelled_cells(spark, d))


@register("cluster_region_totals_fixed", q(_CLUSTER_REGION_SQL))
def cluster_region_totals_fixed(spark, d):
    return _cluster_region(spark, d)


@register("top_region_per_cluster_fixed", q(
    f"SELECT prediction AS cluster, cell_spa AS top_spa, spa_crimes FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY prediction ORDER BY cell_spa IS NULL, spa_crimes DESC, cell_spa) AS rn "
    f"FROM ({_CLUSTER_REGION_SQL})) WHERE rn = 1"))
def top_region_per_cluster_fixed(spark, d):
    return M.top_region_per_cluster(_cluster_region(spark, d))


# ============================================================ ML, stages of the fitted models

def stored_panel(spark, d) -> DataFrame:
    """The region x month panel, a few hundred rows, written once: the model's
    stages and its evaluation read it instead of the incidents."""
    return reliable_checkpoint(A.region_month_panel(B.enriched(spark, d)).coalesce(1).sortWithinPartitions(*PANEL_KEYS))


@register("assembled_features", q(
    f"SELECT spa, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS f{i}' for i, c in enumerate(_PROFILE_COLS))} "
    f"FROM ({_profile_sql('enriched', ['spa'], rounded=False)})"))
def assembled_features(spark, d):
    vec = M.assemble_cells(A.region_profile(B.enriched(spark, d)), _PROFILE_COLS)
    f = vector_to_array("features")
    return vec.select("spa", *[F.round(f[i], 6).alias(f"f{i}") for i in range(len(_PROFILE_COLS))])


# Frequency order, ties by label; the "keep" index of unseen labels is the one-hot slot left out.
_INDEX_SQL = (f"SELECT p.*, CAST(i.idx AS DOUBLE) AS spa_idx, i.idx AS hot, i.n_labels FROM "
              f"({_profile_sql('enriched', PANEL_KEYS, rounded=False)}) p JOIN (SELECT spa, "
              f"row_number() OVER (ORDER BY count(*) DESC, spa) - 1 AS idx, count(*) OVER () AS n_labels "
              f"FROM ({_profile_sql('enriched', PANEL_KEYS, rounded=False)}) GROUP BY spa) i ON p.spa = i.spa")


@register("region_index_onehot", q(f'SELECT spa, "Occured_Year", "Occured_Month", spa_idx, CAST(hot AS INTEGER) AS hot_slot, '
                                   f'CAST(n_labels AS INTEGER) AS n_slots, 1.0::DOUBLE AS hot_sum FROM ({_INDEX_SQL})'))
def region_index_onehot(spark, d):
    panel = stored_panel(spark, d)
    out = Pipeline(stages=M.region_stages()).fit(panel).transform(panel)
    hot = vector_to_array("spa_ohe")
    return out.select(*PANEL_KEYS, "spa_idx", (F.array_position(hot, 1.0) - 1).cast("int").alias("hot_slot"),
                      F.size(hot).alias("n_slots"), F.aggregate(hot, F.lit(0.0), lambda a, x: a + x).alias("hot_sum"))


_FIXED_PAIRS_SQL = (f"SELECT crime_count, avg_victim_age * 2.0::DOUBLE + weapon_rate * 50.0::DOUBLE AS p "
                    f"FROM ({_profile_sql('enriched', PANEL_KEYS, rounded=False)})")


@register("prediction_pairs_fixed", q(
    f"SELECT crime_count, round(p, 6) AS prediction, round(least(min(crime_count) OVER (), min(p) OVER ()), 6) AS range_lo, "
    f"round(greatest(max(crime_count) OVER (), max(p) OVER ()), 6) AS range_hi FROM ({_FIXED_PAIRS_SQL})"))
def prediction_pairs_fixed(spark, d):
    panel = A.region_month_panel(B.enriched(spark, d))
    pred = panel.withColumn("prediction", F.col("avg_victim_age") * F.lit(2.0) + F.col("weapon_rate") * F.lit(50.0))
    return r6(M.prediction_pairs(pred), "prediction", "range_lo", "range_hi")


@register("tracts_from_money", q(
    "SELECT tract, spa, round(coalesce(m, (SELECT avg(CASE WHEN ami_category = 'Low Income' THEN m END) FROM money)), 6) "
    "AS med_hh_income FROM money",
    ", money AS (SELECT CAST(tract AS VARCHAR) AS tract, regexp_replace(spa, '^\\s+|\\s+$', '', 'g') AS spa, ami_category, "
    "TRY_CAST(regexp_replace(med_hh_income_text, '[$,\\s]', '', 'g') AS DOUBLE) AS m FROM raw_tract)"))
def tracts_from_money(spark, d):
    from ..functions import parse_money as pm
    raw = B.raw_tracts(spark, d).withColumn("med_hh_income", pm("med_hh_income_text")).drop("med_hh_income_text")
    return r6(C.clean_tracts(raw).select("tract", "spa", "med_hh_income"), "med_hh_income")


@register("cluster_totals_all", q(
    f"SELECT CAST(list_position([{_D2}], list_min([{_D2}])) - 1 AS INTEGER) AS prediction, "
    f"CAST(sum(count) AS BIGINT) AS total_crimes FROM ({_hot_sql('geo', None)}) GROUP BY 1"))
def cluster_totals_all(spark, d):
    """Totals over every cell (the capped form above is the source's)."""
    return M.cluster_totals(M.assign_nearest(G.hotspots(B.geo(spark, d), SCALE), FIXED_CENTERS))


for _scale in (200, 1000):  # the report's other grid scales, every cell
    register(f"hotspots_scale_{_scale}", q(
        f'SELECT *, lat_i / {_scale}.0::DOUBLE AS lat_grid, lon_i / {_scale}.0::DOUBLE AS lon_grid FROM (SELECT '
        f'{grid_i(chr(34) + "LAT_d" + chr(34), _scale)} AS lat_i, {grid_i(chr(34) + "LON_d" + chr(34), _scale)} AS lon_i, '
        f'count(*) AS count FROM geo GROUP BY 1, 2)'))(
        lambda spark, d, scale=_scale: G.hotspots(B.geo(spark, d), scale))


# ============================================================ flagship



@register("flagship_hotspot_regions", q(
    f"SELECT h.*, dm.spa FROM ({_hot_sql('geo', 8000)}) h LEFT JOIN ({_DOMINANT_SQL}) dm "
    f"ON h.lat_i = dm.lat_i AND h.lon_i = dm.lon_i"))
def flagship_hotspot_regions(spark, d):
    return _flagship(spark, d, SCALE, 8000)


# ============================================================ the report's default view
# The interactive report runs its queries on the filtered frame; its default
# choice is every region, the latest three years and every listed month.

_DEFAULT_VIEW = f'(SELECT * FROM enriched WHERE {_LATEST} AND "Occured_Month" IS NOT NULL)'
_DEFAULT_GEO = (f'(SELECT *, CAST("LAT" AS DOUBLE) AS "LAT_d", CAST("LON" AS DOUBLE) AS "LON_d" FROM {_DEFAULT_VIEW} '
                f'WHERE CAST("LAT" AS DOUBLE) BETWEEN 33.5 AND 34.5 AND CAST("LON" AS DOUBLE) BETWEEN -119.0 AND -117.0)')


def default_view(spark, d) -> DataFrame:
    return FL.filter_defaults(B.enriched(spark, d))


@register("view_hotspots", q(f"SELECT *, round(ln(1 + count), 6) AS weight FROM ({_hot_sql(_DEFAULT_GEO, 8000)})"))
def view_hotspots(spark, d):
    cells = G.hotspots(C.valid_geo(default_view(spark, d)), SCALE, 8000)
    return r6(G.add_weight(cells), "weight")


@register("view_top_crimes", q(_count_sql(_DEFAULT_VIEW, ["Crm_Cd_Desc"], TOP_N)))
def view_top_crimes(spark, d):
    return A.top_counts(default_view(spark, d), "Crm_Cd_Desc", TOP_N)


@register("view_income_vs_count", q(f"SELECT spa, round(avg(med_hh_income), 6) AS avg_income, count(*) AS crime_count "
                                    f"FROM {_DEFAULT_VIEW} GROUP BY spa"))
def view_income_vs_count(spark, d):
    return r6(A.income_vs_count(default_view(spark, d)), "avg_income")


_DEFAULT_NEAR = (f'(SELECT *, {haversine_sql(*CENTER)} AS dist_km FROM {_DEFAULT_GEO})')


@register("view_box_crimes", q(_count_sql(f"(SELECT * FROM {_DEFAULT_GEO} WHERE {_BOX_WHERE})", ["Crm_Cd_Desc"], TOP_N)))
def view_box_crimes(spark, d):
    return A.top_counts(G.within_box(C.valid_geo(default_view(spark, d)), *BOX), "Crm_Cd_Desc", TOP_N)


@register("view_radius_crimes", q(_count_sql(f"(SELECT * FROM {_DEFAULT_NEAR} WHERE dist_km <= {lit(RADIUS_KM)})",
                                             ["Crm_Cd_Desc"], TOP_N)))
def view_radius_crimes(spark, d):
    near = G.within_radius(C.valid_geo(default_view(spark, d)), *CENTER, RADIUS_KM)
    return A.top_counts(near, "Crm_Cd_Desc", TOP_N)


_PICKED_NEAR = f"(SELECT *, {haversine_sql(*CENTER)} AS dist_km FROM geo WHERE {_F_WHERE})"


@register("view_nearest", q(f'SELECT "DR_NO", round(dist_km, 6) AS dist_km FROM {_PICKED_NEAR} WHERE dist_km <= {lit(NEAREST_KM)} '
                            f'ORDER BY dist_km, "DR_NO" LIMIT 50'))
def view_nearest(spark, d):
    near = G.nearest(FL.apply_filters(B.geo(spark, d), **_FILTERS), *CENTER, NEAREST_KM, 50)
    return r6(near.select("DR_NO", "dist_km"), "dist_km")


# ============================================================ spatial reports on the fan-out join
# The source's spatial and clustering notebooks read the merged (J1) table,
# so their counts carry each region's income multiplier; these twins keep
# that parity.

FANOUT_SPATIAL: list[tuple[str, Query, str]] = [
    ("hotspots_topk_fanout", lambda spark, d: G.hotspots(B.geo_fanout(spark, d), SCALE, 8000, weight=W),
     _hot_sql("geo_fanout", 8000)),
    ("hotspots_min_count_fanout",
     lambda spark, d: G.hotspots(B.geo_fanout(spark, d), SCALE, None, min_count=10, weight=W),
     _hot_sql("geo_fanout", None, 10)),
    ("hotspots_day_night_fanout", lambda spark, d: G.hotspots_by_part(B.geo_fanout(spark, d), SCALE, 6000, weight=W),
     _day_night_sql("geo_fanout")),
    ("hotspots_month_fanout",
     lambda spark, d: G.hotspots(G.filter_month(B.geo_fanout(spark, d), *MONTH_PICK), SCALE, 5000, weight=W),
     _hot_sql(f'(SELECT * FROM geo_fanout WHERE "Occured_Year" = {MONTH_PICK[0]} '
              f'AND "Occured_Month" = {MONTH_PICK[1]})', 5000)),
    ("hexbin_fanout",
     lambda spark, d: r6(G.hexbin(B.geo_fanout(spark, d), HEX_GRIDSIZE, HEX_EXTENT, weight=W), "hex_x", "hex_y"),
     _hexbin_sql("geo_fanout")),
    ("top_crimes_box_fanout",
     lambda spark, d: A.top_counts(G.within_box(B.geo_fanout(spark, d), *BOX), "Crm_Cd_Desc", TOP_N, weight=W),
     _count_sql(f"(SELECT * FROM geo_fanout WHERE {_BOX_WHERE})", ["Crm_Cd_Desc"], TOP_N)),
    ("top_crimes_radius_fanout",
     lambda spark, d: A.top_counts(G.within_radius(B.geo_fanout(spark, d), *CENTER, RADIUS_KM), "Crm_Cd_Desc", TOP_N,
                                   weight=W),
     _count_sql(f"(SELECT * FROM {_near_src('geo_fanout')} WHERE dist_km <= {lit(RADIUS_KM)})",
                ["Crm_Cd_Desc"], TOP_N)),
    ("cell_region_counts_fanout", lambda spark, d: A.cell_region_counts(B.enriched_weighted(spark, d), SCALE, W),
     _cell_region_sql("enriched_fanout")),
    ("dominant_region_per_cell_fanout",
     lambda spark, d: R.top_one_per_group(A.cell_region_counts(B.enriched_weighted(spark, d), SCALE, W),
                                          ["lat_i", "lon_i"], "n", "spa"),
     _dominant_sql("enriched_fanout")),
    ("cluster_input_fanout",
     lambda spark, d: G.hotspots(B.geo_fanout(spark, d).select("LAT_d", "LON_d", W).na.drop(), SCALE, CLUSTER_K,
                                 weight=W),
     _hot_sql('(SELECT "LAT_d", "LON_d" FROM geo_fanout WHERE "LAT_d" IS NOT NULL AND "LON_d" IS NOT NULL)',
              CLUSTER_K)),
]

for _name, _fn, _sql in FANOUT_SPATIAL:
    register(_name, q(_sql))(_fn)


# ============================================================ statistics and clusters on the fan-out join

_HOT_FANOUT = _hot_sql('(SELECT "LAT_d", "LON_d" FROM geo_fanout WHERE "LAT_d" IS NOT NULL AND "LON_d" IS NOT NULL)', CLUSTER_K)
_PRED_FANOUT = (f"SELECT *, CAST(list_position([{_D2}], list_min([{_D2}])) - 1 AS INTEGER) AS prediction FROM ({_HOT_FANOUT})")
_LABELLED_FANOUT = (f"SELECT p.*, dm.spa FROM ({_PRED_FANOUT}) p LEFT JOIN ({_dominant_sql('enriched_fanout')}) dm "
                    f"ON p.lat_i = dm.lat_i AND p.lon_i = dm.lon_i")
_REGION_FANOUT = (f"SELECT prediction, spa AS cell_spa, CAST(sum(count) AS BIGINT) AS spa_crimes "
                  f"FROM ({_LABELLED_FANOUT}) GROUP BY prediction, spa")


def _fixed_metrics_fanout(spark, d) -> DataFrame:
    panel = A.region_month_panel(B.enriched_weighted(spark, d), weight=W)
    _, test = M.split_by_key(panel, PANEL_KEYS)
    pred = test.withColumn("prediction", F.col("avg_victim_age") * F.lit(2.0) + F.col("weapon_rate") * F.lit(50.0))
    return r6(M.regression_metrics(pred), "rmse", "r2")


FANOUT_MODELS: list[tuple[str, Query, str, str]] = [
    ("correlation_long_fanout",
     lambda spark, d: r6(M.correlation_long(A.region_profile(B.enriched_weighted(spark, d), weight=W), _PROFILE_COLS), "r"),
     " UNION ALL ".join(_corr_cell(a, b) for a in _PROFILE_COLS for b in _PROFILE_COLS), _corr_cte("enriched_fanout")),
    ("regression_metrics_fixed_fanout", _fixed_metrics_fanout, _FIXED_REG_SQL.replace("FROM enriched", "FROM enriched_fanout"), ""),
    ("cluster_summary_fixed_fanout",
     lambda spark, d: r6(M.cluster_summary(labelled_cells(spark, d, W)), "center_lat", "center_lon"),
     f"SELECT prediction, count(*) AS num_cells, CAST(sum(count) AS BIGINT) AS total_crimes_in_cells, "
     f"round(avg(lat_grid), 6) AS center_lat, round(avg(lon_grid), 6) AS center_lon FROM ({_PRED_FANOUT}) GROUP BY prediction", ""),
    ("cluster_totals_fixed_fanout", lambda spark, d: M.cluster_totals(labelled_cells(spark, d, W)),
     f"SELECT prediction, CAST(sum(count) AS BIGINT) AS total_crimes FROM ({_PRED_FANOUT}) GROUP BY prediction", ""),
    ("cluster_region_totals_fixed_fanout", lambda spark, d: M.cluster_region_totals(labelled_cells(spark, d, W)), _REGION_FANOUT, ""),
    ("top_region_per_cluster_fixed_fanout",
     lambda spark, d: M.top_region_per_cluster(M.cluster_region_totals(labelled_cells(spark, d, W))),
     f"SELECT prediction AS cluster, cell_spa AS top_spa, spa_crimes FROM (SELECT *, row_number() OVER "
     f"(PARTITION BY prediction ORDER BY cell_spa IS NULL, spa_crimes DESC, cell_spa) AS rn FROM ({_REGION_FANOUT})) WHERE rn = 1", ""),
    ("label_cells_fanout", lambda spark, d: labelled_cells(spark, d, W), _LABELLED_FANOUT, ""),
]

for _name, _fn, _sql, _cte in FANOUT_MODELS:
    register(_name, q(_sql, _cte))(_fn)
