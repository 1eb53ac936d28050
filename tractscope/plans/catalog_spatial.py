"""Spatial queries over tables of centers and whole rankings."""

from __future__ import annotations

from ..operators import spatial as G
from . import frames as B
from .catalog import SCALE, _day_night_sql, r6, register
from .oracle import lit, q

RINGS_N = 5

register("hotspots_by_part_all", q(_day_night_sql().replace(" WHERE rank <= 6000", "")))(
    lambda spark, d: G.hotspots_by_part(B.geo(spark, d), SCALE))

_CENTERS = (f", centers AS (SELECT s_suppkey AS center_id, CASE WHEN s_suppkey % 10 = 0 THEN {lit(30.0)} + CAST((s_suppkey * 7) % 100 AS DOUBLE) * {lit(0.1)} "
            f"ELSE {lit(33.7)} + CAST((s_suppkey * 37) % 1000 AS DOUBLE) * {lit(0.00065)} END AS center_lat, "
            f"CASE WHEN s_suppkey % 10 = 0 THEN {lit(-125.0)} + CAST((s_suppkey * 11) % 100 AS DOUBLE) * {lit(0.15)} "
            f"ELSE {lit(-118.7)} + CAST((s_suppkey * 91) % 1000 AS DOUBLE) * {lit(0.00055)} END AS center_lon FROM supplier)")
_LAT, _LON = "radians(g.\"LAT_d\")", "radians(g.\"LON_d\")"
_S1, _S2 = f"sin(({_LAT} - radians(center_lat)) / 2)", f"sin(({_LON} - radians(center_lon)) / 2)"
_KM = (f"({lit(2.0 * 6371.0)} * asin(least({lit(1.0)}, sqrt({_S1} * {_S1} + cos(radians(center_lat)) * cos({_LAT}) * ({_S2} * {_S2})))))")


@register("nearest_rings", q(
    f"SELECT center_id, CAST(rank AS INTEGER) AS rank, \"DR_NO\", round(dist_km, 6) AS dist_km FROM (SELECT center_id, \"DR_NO\", dist_km, row_number() OVER "
    f"(PARTITION BY center_id ORDER BY dist_km, \"DR_NO\") AS rank FROM (SELECT center_id, \"DR_NO\", {_KM} AS dist_km FROM centers, geo g)) "
    f"WHERE rank <= {RINGS_N}", _CENTERS))
def nearest_rings(spark, d):
    """The incidents nearest to each of a table of centers, whatever the distance."""
    return r6(G.nearest_rings(B.geo(spark, d), B.centers(spark, d), RINGS_N), "dist_km")
