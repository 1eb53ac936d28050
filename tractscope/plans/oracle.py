"""DuckDB twins of the registered queries.

``PRELUDE`` derives the same incident and tract tables from the test
views ``orders`` and ``supplier`` with integer arithmetic, CASE and casts,
then cleans, maps and joins them as the Spark operators do.  Each oracle
query is ``PRELUDE + <final SELECT>``; DuckDB skips the CTEs a query does
not reference.
"""

from __future__ import annotations

import math

from ..schemas import AREA_TO_REGION, CITY_BOX, LOW_INCOME, OTHER_REGION
from ..sources.fixtures import FIXTURE_AREAS, FIXTURE_DESCENT, FIXTURE_REGIONS


def lit(v) -> str:
    """SQL literal; doubles in exponent form so DuckDB reads DOUBLE."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return format(v, ".17e")
    return "'" + str(v).replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def _case_index(expr: str, values: list) -> str:
    whens = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values) if v is not None)
    return f"CASE {expr} {whens} END"


def _region_case(col: str) -> str:
    by_region: dict[str, list[str]] = {}
    for area, region in AREA_TO_REGION.items():
        by_region.setdefault(region, []).append(area)
    whens = " ".join(f"WHEN {col} IN {in_list(a)} THEN {lit(r)}" for r, a in by_region.items())
    return f"CASE {whens} ELSE {lit(OTHER_REGION)} END"


DATE_FMT = "'%m/%d/%Y %I:%M:%S %p'"
K, C, S = "o_orderkey", "o_custkey", "s_suppkey"
_A = f"(({K} * 7919) % 1000)"
_B = f"(({K} * 104729 + {C} * 31) % 1000)"
_W = f"(({K} * 31 + {C}) % 3 = 0)"
_V = f"(40000 + ({S} % 37) * 2500)"
LAT_MIN, LAT_MAX, LON_MIN, LON_MAX = CITY_BOX

PRELUDE = f"""
WITH
raw_incident AS (
  SELECT
    {K} AS "DR_NO",
    strftime(CAST(o_orderdate AS DATE) + CAST({K} % 30 AS INTEGER), {DATE_FMT}) AS "Date Rptd",
    strftime(CAST(o_orderdate AS DATE), {DATE_FMT}) AS "DATE OCC",
    CAST((({K} * 37 + {C} * 11) % 24) * 100 + {K} % 60 AS INTEGER) AS "TIME OCC",
    {_case_index(f"{C} % 21", FIXTURE_AREAS)} AS "AREA NAME",
    o_orderpriority || ' / ' || o_orderstatus AS "Crm Cd Desc",
    CAST(({C} * 13 + {K} * 7) % 90 - 2 AS INTEGER) AS "Vict Age",
    {_case_index(f"{K} % 5", FIXTURE_DESCENT)} AS "Vict Descent",
    'PREMISE ' || CAST({C} % 7 AS VARCHAR) AS "Premis Desc",
    CASE WHEN {_W} THEN CAST(100 + {K} % 17 AS INTEGER) END AS "Weapon Used Cd",
    CASE WHEN {_W} THEN 'WEAPON ' || CAST(100 + {K} % 17 AS VARCHAR) END AS "Weapon Desc",
    CASE WHEN {K} % 97 = 0 THEN {lit(0.0)} WHEN {K} % 89 = 0 THEN {lit(40.5)}
         ELSE {lit(33.7)} + CAST({_A} * {_A} AS DOUBLE) * {lit(0.00000065)} END AS "LAT",
    CASE WHEN {K} % 97 = 0 THEN {lit(0.0)}
         ELSE {lit(-118.7)} + CAST({_B} * {_B} AS DOUBLE) * {lit(0.00000055)} END AS "LON"
  FROM orders
),
raw_tract AS (
  SELECT
    {S} AS tract,
    CASE WHEN {S} % 2 = 0 THEN '  ' ELSE '' END || {_case_index(f"{S} % 5", FIXTURE_REGIONS)} || ' ' AS spa,
    CASE WHEN {S} % 33 = 0 THEN NULL ELSE CAST({_V} AS DOUBLE) END AS med_hh_income,
    CASE WHEN {S} % 33 = 0 THEN NULL WHEN {S} % 37 < 12 THEN 'Low Income'
         WHEN {S} % 37 < 24 THEN 'Moderate Income' ELSE 'Above Moderate Income' END AS ami_category,
    CASE WHEN {S} % 33 = 0 THEN NULL ELSE
      '$' || CAST({_V} // 1000 AS VARCHAR) || ',' || lpad(CAST({_V} % 1000 AS VARCHAR), 3, '0') || ' ' END
      AS med_hh_income_text
  FROM supplier
),
renamed AS (
  SELECT "DR_NO", "Date Rptd" AS "Date_Rptd", "DATE OCC" AS "DATE_OCC", "TIME OCC" AS "TIME_OCC",
         "AREA NAME" AS "AREA_NAME", "Crm Cd Desc" AS "Crm_Cd_Desc", "Vict Age" AS "Vict_Age",
         "Vict Descent" AS "Vict_Descent", "Premis Desc" AS "Premis_Desc",
         "Weapon Used Cd" AS "Weapon_Used_Cd", "Weapon Desc" AS "Weapon_Desc", "LAT", "LON"
  FROM raw_incident
),
dated AS (
  SELECT *,
    CAST(try_strptime("DATE_OCC", {DATE_FMT}) AS DATE) AS "Date_Occured",
    CAST(try_strptime("Date_Rptd", {DATE_FMT}) AS DATE) AS "Date_Reported"
  FROM renamed
),
clean_incident AS (
  SELECT *,
    CAST(year("Date_Occured") AS INTEGER) AS "Occured_Year",
    CAST(month("Date_Occured") AS INTEGER) AS "Occured_Month",
    CAST(day("Date_Occured") AS INTEGER) AS "Occured_Day",
    CAST("TIME_OCC" // 100 AS INTEGER) AS "Hour",
    CASE WHEN "Weapon_Used_Cd" IS NOT NULL THEN 'Yes' ELSE 'No' END AS "Weapon_Used"
  FROM dated
  WHERE "LAT" != 0 AND "LON" != 0 AND "Vict_Age" > 0
),
region_incident AS (
  SELECT *, {_region_case('"AREA_NAME"')} AS spa FROM clean_incident
),
low_mean AS (
  SELECT avg(CASE WHEN ami_category = {lit(LOW_INCOME)} THEN med_hh_income END) AS m FROM raw_tract
),
imputed_tract AS (
  SELECT tract, spa, coalesce(med_hh_income, (SELECT m FROM low_mean)) AS med_hh_income,
         ami_category, med_hh_income_text, med_hh_income IS NULL AS was_imputed
  FROM raw_tract
),
clean_tract AS (
  SELECT CAST(tract AS VARCHAR) AS tract, regexp_replace(spa, '^\\s+|\\s+$', '', 'g') AS spa,
         med_hh_income, ami_category, med_hh_income_text
  FROM imputed_tract
),
domain_tract AS (
  SELECT * FROM clean_tract WHERE spa IS NOT NULL
),
category_mode AS (
  SELECT spa, ami_category FROM (
    SELECT spa, ami_category,
           row_number() OVER (PARTITION BY spa ORDER BY count(*) DESC, ami_category) AS rn
    FROM domain_tract WHERE ami_category IS NOT NULL GROUP BY spa, ami_category
  ) WHERE rn = 1
),
region_income AS (
  SELECT r.spa, r.med_hh_income, m.ami_category
  FROM (SELECT spa, avg(med_hh_income) AS med_hh_income FROM domain_tract GROUP BY spa) r
  LEFT JOIN category_mode m ON r.spa = m.spa
),
enriched AS (
  SELECT i.*, r.med_hh_income, r.ami_category
  FROM region_incident i LEFT JOIN region_income r ON i.spa = r.spa
),
income_triples AS (
  SELECT DISTINCT spa, med_hh_income, ami_category FROM domain_tract
),
enriched_fanout AS (
  SELECT i.*, t.med_hh_income, t.ami_category
  FROM region_incident i LEFT JOIN income_triples t ON i.spa = t.spa
),
geo AS (
  SELECT *, CAST("LAT" AS DOUBLE) AS "LAT_d", CAST("LON" AS DOUBLE) AS "LON_d" FROM enriched
  WHERE CAST("LAT" AS DOUBLE) BETWEEN {lit(LAT_MIN)} AND {lit(LAT_MAX)}
    AND CAST("LON" AS DOUBLE) BETWEEN {lit(LON_MIN)} AND {lit(LON_MAX)}
),
geo_fanout AS (
  SELECT *, CAST("LAT" AS DOUBLE) AS "LAT_d", CAST("LON" AS DOUBLE) AS "LON_d" FROM enriched_fanout
  WHERE CAST("LAT" AS DOUBLE) BETWEEN {lit(LAT_MIN)} AND {lit(LAT_MAX)}
    AND CAST("LON" AS DOUBLE) BETWEEN {lit(LON_MIN)} AND {lit(LON_MAX)}
)
"""


def q(body: str, extra_ctes: str = "") -> str:
    """Oracle query: the prelude, optional extra CTEs (``, name AS (...)``)
    and the final SELECT."""
    return PRELUDE + extra_ctes + "\n" + body


# -- reusable SQL expressions ---------------------------------------------------

def grid_i(col: str, scale: int) -> str:
    return f"CAST(floor({col} * {scale}) AS BIGINT)"


def haversine_sql(lat0: float, lon0: float, lat: str = '"LAT_d"', lon: str = '"LON_d"',
                  radius_km: float = 6371.0) -> str:
    la0, lo0 = f"radians({lit(float(lat0))})", f"radians({lit(float(lon0))})"
    s_lat = f"sin((radians({lat}) - {la0}) / 2)"
    s_lon = f"sin((radians({lon}) - {lo0}) / 2)"
    a = f"({s_lat} * {s_lat} + cos({la0}) * cos(radians({lat})) * ({s_lon} * {s_lon}))"
    return f"({lit(2.0 * radius_km)} * asin(least({lit(1.0)}, sqrt({a}))))"


def hex_sql(x: str, y: str, gridsize: int, extent) -> dict[str, str]:
    xmin, xmax, ymin, ymax = (float(v) for v in extent)
    nx = int(gridsize)
    ny = int(nx / math.sqrt(3))
    sx = (xmax - xmin) / nx
    sy = (ymax - ymin) / ny
    ix = f"(({x} - {lit(xmin)}) / {lit(sx)})"
    iy = f"(({y} - {lit(ymin)}) / {lit(sy)})"
    ix1, iy1 = f"floor({ix} + {lit(0.5)})", f"floor({iy} + {lit(0.5)})"
    ix2, iy2 = f"floor({ix})", f"floor({iy})"
    dx1, dy1 = f"({ix} - {ix1})", f"({iy} - {iy1})"
    dx2, dy2 = f"({ix} - {ix2} - {lit(0.5)})", f"({iy} - {iy2} - {lit(0.5)})"
    d1 = f"({dx1} * {dx1} + {lit(3.0)} * ({dy1} * {dy1}))"
    d2 = f"({dx2} * {dx2} + {lit(3.0)} * ({dy2} * {dy2}))"
    first = f"({d1} < {d2})"
    return {
        "lattice": f"CASE WHEN {first} THEN 0 ELSE 1 END",
        "col": f"CAST(CASE WHEN {first} THEN {ix1} ELSE {ix2} END AS BIGINT)",
        "row": f"CAST(CASE WHEN {first} THEN {iy1} ELSE {iy2} END AS BIGINT)",
        "inside": (f"CASE WHEN {first} THEN ({ix1} BETWEEN 0 AND {nx} AND {iy1} BETWEEN 0 AND {ny}) "
                   f"ELSE ({ix2} BETWEEN 0 AND {nx - 1} AND {iy2} BETWEEN 0 AND {ny - 1}) END"),
        "cx": lambda lat_, col_: f"({lit(xmin)} + ({col_} + CASE WHEN {lat_} = 0 THEN {lit(0.0)} ELSE {lit(0.5)} END) * {lit(sx)})",
        "cy": lambda lat_, row_: f"({lit(ymin)} + ({row_} + CASE WHEN {lat_} = 0 THEN {lit(0.0)} ELSE {lit(0.5)} END) * {lit(sy)})",
    }
