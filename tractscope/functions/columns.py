"""Scalar column expressions used by the operators.

All of them are plain ``pyspark.sql.functions`` compositions, so they stay
inside whole-stage codegen and can be pushed or pruned by Catalyst.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import (
    AREA_TO_REGION,
    DATE_PATTERN,
    DAY_END_HOUR,
    DAY_START_HOUR,
    EARTH_RADIUS_KM,
    OTHER_REGION,
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date_text(c: str | Column, pattern: str = DATE_PATTERN) -> Column:
    """12-hour text such as ``01/02/2020 12:00:00 AM`` to a date; bad text
    or null gives null instead of an error (ANSI mode is on)."""
    return F.try_to_date(_col(c), pattern)


def hour_from_hhmm(c: str | Column) -> Column:
    """HHMM number to the hour: divide by 100 and truncate (1310 -> 13)."""
    return (_col(c) / F.lit(100)).cast("int")


def weapon_flag(c: str | Column) -> Column:
    """``Yes`` when a weapon code is present, else ``No``."""
    return F.when(_col(c).isNotNull(), F.lit("Yes")).otherwise(F.lit("No"))


def parse_money(c: str | Column) -> Column:
    """Money text (``$61,994 ``, ``61994.5``) to double; junk gives null."""
    return F.regexp_replace(_col(c), r"[$,\s]", "").try_cast("double")


def region_of_area(c: str | Column, mapping: Mapping[str, str] = AREA_TO_REGION,
                   other: str = OTHER_REGION) -> Column:
    """Map a police-area label to its region; unknown or null -> ``other``.

    The mapping is data: it is folded into one CASE of ``isin`` tests, a
    projection with no join and no shuffle.
    """
    by_region: dict[str, list[str]] = {}
    for area, region in mapping.items():
        by_region.setdefault(region, []).append(area)
    col = _col(c)
    expr = None
    for region, areas in by_region.items():
        cond = col.isin(*areas)
        expr = F.when(cond, F.lit(region)) if expr is None else expr.when(cond, F.lit(region))
    return F.lit(other) if expr is None else expr.otherwise(F.lit(other))


def day_part(hour: str | Column) -> Column:
    """``Day`` for 6 <= hour < 18, ``Night`` otherwise (null hour too)."""
    h = _col(hour)
    is_day = (h >= DAY_START_HOUR) & (h < DAY_END_HOUR)
    return F.when(is_day, F.lit("Day")).otherwise(F.lit("Night"))


def grid_index(c: str | Column, scale: int) -> Column:
    """Integer cell index on a lattice of ``1/scale`` degrees (floor, so
    negative longitudes move west); null where the coordinate is not finite
    (the floor of NaN would be cell 0)."""
    v = _col(c)
    return F.when(F.abs(v.cast("double")) < F.lit(float("inf")), F.floor(v * F.lit(scale)))


def haversine_km(lat0: float | Column, lon0: float | Column,
                 lat: str | Column, lon: str | Column,
                 radius_km: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance in km; the ``asin`` argument is clamped to 1."""
    la0 = F.radians(lat0 if isinstance(lat0, Column) else F.lit(float(lat0)))
    lo0 = F.radians(lon0 if isinstance(lon0, Column) else F.lit(float(lon0)))
    la, lo = F.radians(_col(lat)), F.radians(_col(lon))
    s_lat = F.sin((la - la0) / 2)
    s_lon = F.sin((lo - lo0) / 2)
    a = s_lat * s_lat + F.cos(la0) * F.cos(la) * (s_lon * s_lon)
    return F.lit(2.0 * radius_km) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def hex_cell(x: str | Column, y: str | Column, gridsize: int,
             extent: tuple[float, float, float, float]) -> list[dict[str, Column]]:
    """Hexagonal bin of a point (Carr et al., 1987): two rectangular
    lattices offset by half a cell; the nearer center (with the y axis
    scaled by sqrt 3) wins.

    ``extent`` is ``(xmin, xmax, ymin, ymax)``; the lattice has ``gridsize``
    columns and ``int(gridsize / sqrt(3))`` rows; rounding is
    ``floor(v + 0.5)``.  Returns three steps of columns to apply with
    successive ``withColumns`` calls, so every intermediate value is
    computed once (one expression tree would repeat them).  The last step
    gives ``hex_lattice`` (0 or 1), ``hex_col``, ``hex_row`` and
    ``hex_inside`` (the point belongs to a hexagon of the lattice).
    """
    xmin, xmax, ymin, ymax = (float(v) for v in extent)
    nx = int(gridsize)
    ny = int(nx / math.sqrt(3))
    sx = (xmax - xmin) / nx
    sy = (ymax - ymin) / ny
    ix, iy = F.col("__hx"), F.col("__hy")
    step1 = {"__hx": (_col(x) - F.lit(xmin)) / F.lit(sx), "__hy": (_col(y) - F.lit(ymin)) / F.lit(sy)}
    step2 = {
        "__hx1": F.floor(ix + F.lit(0.5)), "__hy1": F.floor(iy + F.lit(0.5)),
        "__hx2": F.floor(ix), "__hy2": F.floor(iy),
    }
    ix1, iy1, ix2, iy2 = (F.col(c) for c in ("__hx1", "__hy1", "__hx2", "__hy2"))
    dx1, dy1 = ix - ix1, iy - iy1
    dx2, dy2 = ix - ix2 - F.lit(0.5), iy - iy2 - F.lit(0.5)
    d1 = dx1 * dx1 + F.lit(3.0) * (dy1 * dy1)
    d2 = dx2 * dx2 + F.lit(3.0) * (dy2 * dy2)
    step3 = {"__hfirst": d1 < d2}
    first = F.col("__hfirst")
    step4 = {
        "hex_lattice": F.when(first, F.lit(0)).otherwise(F.lit(1)),
        "hex_col": F.when(first, ix1).otherwise(ix2),
        "hex_row": F.when(first, iy1).otherwise(iy2),
        "hex_inside": F.when(first, ix1.between(0, nx) & iy1.between(0, ny))
                       .otherwise(ix2.between(0, nx - 1) & iy2.between(0, ny - 1)),
    }
    return [step1, step2, step3, step4]


def hex_center(lattice: str | Column, col: str | Column, row: str | Column, gridsize: int,
               extent: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """Center (x, y) of a hexagon given by ``hex_cell``'s keys."""
    xmin, xmax, ymin, ymax = (float(v) for v in extent)
    nx = int(gridsize)
    ny = int(nx / math.sqrt(3))
    sx = (xmax - xmin) / nx
    sy = (ymax - ymin) / ny
    offset = F.when(_col(lattice) == 0, F.lit(0.0)).otherwise(F.lit(0.5))
    return (F.lit(xmin) + (_col(col) + offset) * F.lit(sx),
            F.lit(ymin) + (_col(row) + offset) * F.lit(sy))


def stable_share(key: str | Column | Sequence[str], seed: int) -> Column:
    """A number in [0, 1) that depends on the key alone (a column, or several
    by name): the first 32 bits of the MD5 of ``seed|key``.  Unlike ``sample``/``randomSplit`` it does not
    depend on the partitioning, and unlike key arithmetic it is even on any
    pattern of keys."""
    parts = [key] if isinstance(key, (str, Column)) else list(key)
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[_col(p).cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
