"""Incident and tract frames derived from the TPC-H-like test tables.

``orders`` stands in for incidents (one per order key) and ``supplier``
for census tracts.  Only integer arithmetic, CASE and casts are used, so an
SQL engine can derive the very same rows (see ``plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import AREA_TO_REGION, DATE_PATTERN

# Fixed values of the derivation.
FIXTURE_AREAS = list(AREA_TO_REGION) + ["Unmapped One", None]
FIXTURE_DESCENT = ["H", "W", "B", "A", None]
FIXTURE_REGIONS = [
    "SPA 2 - San Fernando",
    "SPA 4 - Metro",
    "SPA 5 - West",
    "SPA 6 - South",
    "SPA 8 - Unmatched",
]


def _sql_text(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def _pick(values: list, idx: str) -> str:
    """SQL: element ``idx`` (0-based) of a literal list."""
    return f"element_at(array({', '.join(_sql_text(v) for v in values)}), CAST({idx} + 1 AS INT))"


def incidents_from_orders(orders: DataFrame) -> DataFrame:
    """RAW_INCIDENT rows, one per order.

    Written as one ``selectExpr`` (parsed once on the JVM) rather than a
    tree of column calls; literals are doubles (``D``) so the arithmetic is
    the same IEEE sequence as in the SQL oracle."""
    k, c = "o_orderkey", "o_custkey"
    a = f"(({k} * 7919) % 1000)"
    b = f"(({k} * 104729 + {c} * 31) % 1000)"
    weapon = f"(({k} * 31 + {c}) % 3 = 0)"
    code = f"CAST(100 + {k} % 17 AS INT)"
    day = "to_date(o_orderdate)"
    return orders.selectExpr(
        f"{k} AS `DR_NO`",
        f"date_format(date_add({day}, CAST({k} % 30 AS INT)), '{DATE_PATTERN}') AS `Date Rptd`",
        f"date_format({day}, '{DATE_PATTERN}') AS `DATE OCC`",
        f"CAST((({k} * 37 + {c} * 11) % 24) * 100 + {k} % 60 AS INT) AS `TIME OCC`",
        f"{_pick(FIXTURE_AREAS, f'{c} % 21')} AS `AREA NAME`",
        "concat(o_orderpriority, ' / ', o_orderstatus) AS `Crm Cd Desc`",
        f"CAST(({c} * 13 + {k} * 7) % 90 - 2 AS INT) AS `Vict Age`",
        f"{_pick(FIXTURE_DESCENT, f'{k} % 5')} AS `Vict Descent`",
        f"concat('PREMISE ', CAST({c} % 7 AS STRING)) AS `Premis Desc`",
        f"CASE WHEN {weapon} THEN {code} END AS `Weapon Used Cd`",
        f"CASE WHEN {weapon} THEN concat('WEAPON ', CAST({code} AS STRING)) END AS `Weapon Desc`",
        f"CASE WHEN {k} % 97 = 0 THEN 0.0D WHEN {k} % 89 = 0 THEN 40.5D "
        f"ELSE 33.7D + CAST({a} * {a} AS DOUBLE) * 6.5E-7D END AS `LAT`",
        f"CASE WHEN {k} % 97 = 0 THEN 0.0D ELSE -118.7D + CAST({b} * {b} AS DOUBLE) * 5.5E-7D END AS `LON`",
    )


def tracts_from_supplier(supplier: DataFrame) -> DataFrame:
    """RAW_TRACT rows, one per supplier, plus ``med_hh_income_text``: the
    income as money text (``$52,500 ``) for the money parser."""
    s = "s_suppkey"
    v = f"(40000 + ({s} % 37) * 2500)"
    missing = f"({s} % 33 = 0)"
    return supplier.selectExpr(
        f"{s} AS tract",
        f"concat(CASE WHEN {s} % 2 = 0 THEN '  ' ELSE '' END, {_pick(FIXTURE_REGIONS, f'{s} % 5')}, ' ') AS spa",
        f"CASE WHEN NOT {missing} THEN CAST({v} AS DOUBLE) END AS med_hh_income",
        f"CASE WHEN {missing} THEN CAST(NULL AS STRING) WHEN {s} % 37 < 12 THEN 'Low Income' "
        f"WHEN {s} % 37 < 24 THEN 'Moderate Income' ELSE 'Above Moderate Income' END AS ami_category",
        f"CASE WHEN NOT {missing} THEN concat('$', CAST(floor({v} / 1000) AS STRING), ',', "
        f"lpad(CAST({v} % 1000 AS STRING), 3, '0'), ' ') END AS med_hh_income_text",
    )


def load_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(*cols)
    return incidents_from_orders(orders)


def load_tracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracts_from_supplier(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey"))
