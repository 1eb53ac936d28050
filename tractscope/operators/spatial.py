"""Spatial operators on latitude/longitude columns.

Points are two double columns; cells are integer lattice indexes.  All
work is column arithmetic plus partial/final aggregation, so nothing
leaves the JVM and no pair of points is ever formed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as X
from ..schemas import EARTH_RADIUS_KM
from ..session import reliable_checkpoint
from .joins import MAX_BROADCAST_ROWS, join_hot, join_small
from .rank import first_k_by, rank_all, top_per_group


def within_box(df: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float,
               lat: str = "LAT_d", lon: str = "LON_d") -> DataFrame:
    """Points inside the box, all edges inclusive (pushed to the scan)."""
    return df.filter(F.col(lat).between(lat_min, lat_max) & F.col(lon).between(lon_min, lon_max))


def add_grid(df: DataFrame, scale: int = 500, lat: str = "LAT_d", lon: str = "LON_d") -> DataFrame:
    """Cell of each point: ``lat_i``/``lon_i`` (long, the join/group key)
    and ``lat_grid``/``lon_grid`` = index / scale (double)."""
    return df.withColumns({
        "lat_i": X.grid_index(lat, scale),
        "lon_i": X.grid_index(lon, scale),
    }).withColumns({
        "lat_grid": F.col("lat_i") / F.lit(scale),
        "lon_grid": F.col("lon_i") / F.lit(scale),
    })


def _n(weight: str | None) -> F.Column:
    return F.sum(weight).cast("long") if weight else F.count(F.lit(1))


def _cell_counts(df: DataFrame, scale: int, extra_keys: tuple[str, ...] = (),
                 weight: str | None = None) -> DataFrame:
    g = add_grid(df, scale).select(*extra_keys, "lat_i", "lon_i", *([weight] if weight else []))
    return (g.groupBy(*extra_keys, "lat_i", "lon_i").agg(_n(weight).alias("count"))
            .withColumns({"lat_grid": F.col("lat_i") / F.lit(scale),
                          "lon_grid": F.col("lon_i") / F.lit(scale)}))


def hotspots(df: DataFrame, scale: int = 500, k: int | None = None,
             min_count: int | None = None, weight: str | None = None) -> DataFrame:
    """Incident count per grid cell; cells with at least ``min_count``
    incidents (HAVING) and/or the ``k`` busiest cells (ties to the lowest
    cell).  The count is partial per map task, so only one row per cell
    and task is shuffled however dense a cell is."""
    cells = _cell_counts(df, scale, weight=weight)
    if min_count is not None:
        cells = cells.filter(F.col("count") >= min_count)
    if k is None:
        return cells
    return cells.orderBy(F.col("count").desc(), "lat_i", "lon_i").limit(k)


def hotspots_by_part(df: DataFrame, scale: int = 500, k: int | None = None,
                     part: str = "day_part", weight: str | None = None) -> DataFrame:
    """Cells of each day part in one job: ``(part, cell)`` counts, ranked
    within the part; with ``k`` the first ``k`` of each, cut before the
    shuffle; without, every cell, ranked by stretches (``rank_all``)."""
    if part not in df.columns:
        df = df.withColumn(part, X.day_part("Hour"))
    cells = _cell_counts(df, scale, (part,), weight)
    order = [F.col("count").desc(), F.col("lat_i"), F.col("lon_i")]
    if k is None:
        return rank_all(cells, [part], order).withColumn("rank", F.col("rank").cast("int"))
    return top_per_group(cells, [part], order, k, rank_col="rank")


def hotspots_with_region(df: DataFrame, scale: int = 500, k: int | None = None,
                         weight: str | None = None) -> DataFrame:
    """Hotspot cells (points inside the city box) with the region that
    holds most of each cell's incidents (all points, ties to the lowest
    label; points without a region count, but null is no label), in one
    scan: counts per ``(cell, region)`` with a second count
    of the in-box points, then one aggregate per cell for both the count
    and the argmax region.  Equal to ``hotspots`` joined to
    ``dominant_region_per_cell`` (J2) without the join or a second scan."""
    from .clean import geo_flag
    pts = geo_flag(df).select(
        X.grid_index("LAT_d", scale).alias("lat_i"),
        X.grid_index("LON_d", scale).alias("lon_i"),
        "spa", "geo_valid", *([weight] if weight else []),
    ).na.drop(subset=["lat_i", "lon_i"])
    valid = F.col("geo_valid") * F.col(weight) if weight else F.col("geo_valid")
    per_region = pts.groupBy("lat_i", "lon_i", "spa").agg(
        _n(weight).alias("n"), F.sum(valid).cast("long").alias("n_valid"))
    cells = per_region.groupBy("lat_i", "lon_i").agg(
        F.sum("n_valid").alias("count"),
        F.min(F.struct(F.col("spa").isNull().alias("no_label"), (-F.col("n")).alias("neg_n"),
                       F.col("spa").alias("spa"))).alias("best"),
    )
    out = (cells.filter(F.col("count") > 0)
           .select("lat_i", "lon_i", "count",
                   (F.col("lat_i") / F.lit(scale)).alias("lat_grid"),
                   (F.col("lon_i") / F.lit(scale)).alias("lon_grid"),
                   F.col("best.spa").alias("spa")))
    return out if k is None else out.orderBy(F.col("count").desc(), "lat_i", "lon_i").limit(k)


def cell_pyramid(df: DataFrame, scales: Sequence[int] = (1000, 500, 200), lat: str = "LAT_d", lon: str = "LON_d",
                 weight: str | None = None) -> DataFrame:
    """Counts per cell at several grid scales from one scan: (scale, lat_i,
    lon_i, count, lat_grid, lon_grid).

    Points are counted at the finest scale and rolled up by integer division.
    In doubles the floor of a product can differ from the divided floor of the
    finer product (points on or next to a cell edge); that difference, nearly
    always 0, is part of the first aggregate's key, so every scale equals its
    own direct count."""
    fine = max(scales)
    ratios = {s: fine // s for s in scales}
    if any(fine % s for s in scales):
        raise ValueError(f"scales must divide the finest: {sorted(scales)}")
    axes = {"lat": lat, "lon": lon}
    # floor division of an index, negative ones too
    coarse = lambda c, r: (F.col(c) - F.pmod(F.col(c), F.lit(r))) / F.lit(r)
    points = df.select(*[X.grid_index(c, fine).alias(f"{a}_i") for a, c in axes.items()], *axes.values(), *([weight] if weight else []))
    off = {f"{a}_{s}": (X.grid_index(c, s) - coarse(f"{a}_i", r)).cast("int")
           for s, r in ratios.items() if r > 1 for a, c in axes.items()}
    counted = (points.select("lat_i", "lon_i", *[e.alias(n) for n, e in off.items()], *([weight] if weight else []))
               .groupBy("lat_i", "lon_i", *off).agg(_n(weight).alias("n")))

    def cell(axis: str, s: int, r: int) -> F.Column:
        return F.col(f"{axis}_i") if r == 1 else (coarse(f"{axis}_i", r).cast("long") + F.col(f"{axis}_{s}"))

    each = counted.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("scale"), cell("lat", s, r).alias("lat_i"), cell("lon", s, r).alias("lon_i")) for s, r in ratios.items()])).alias("c"), "n")
    return (each.groupBy("c.scale", "c.lat_i", "c.lon_i").agg(F.sum("n").alias("count"))
            .withColumns({"lat_grid": F.col("lat_i") / F.col("scale"), "lon_grid": F.col("lon_i") / F.col("scale")}))


def filter_month(df: DataFrame, year: int, month: int) -> DataFrame:
    return df.filter((F.col("Occured_Year") == year) & (F.col("Occured_Month") == month))


def add_distance(df: DataFrame, lat0: float, lon0: float, lat: str = "LAT_d",
                 lon: str = "LON_d", out: str = "dist_km") -> DataFrame:
    return df.withColumn(out, X.haversine_km(lat0, lon0, lat, lon))


def radius_box(lat0: float, lon0: float, r_km: float,
               radius_km: float = EARTH_RADIUS_KM) -> tuple[float, float, float, float]:
    """A lat/lon box that contains every point within ``r_km`` (slightly
    widened).  Catalyst cannot derive it from trigonometry, so we add it
    as a plain range filter that the Parquet reader can use."""
    dlat = math.degrees(r_km / radius_km) * 1.001 + 1e-9
    edge = min(89.999, abs(lat0) + dlat)
    if edge >= 89.999:
        return (lat0 - dlat, lat0 + dlat, -180.0, 180.0)
    dlon = dlat / math.cos(math.radians(edge)) * 1.001 + 1e-9
    if lon0 - dlon < -180.0 or lon0 + dlon > 180.0:  # across the date line: the distance test decides alone
        return (lat0 - dlat, lat0 + dlat, -180.0, 180.0)
    return (lat0 - dlat, lat0 + dlat, lon0 - dlon, lon0 + dlon)


def within_radius(df: DataFrame, lat0: float, lon0: float, r_km: float = 2.0,
                  lat: str = "LAT_d", lon: str = "LON_d") -> DataFrame:
    """Points within ``r_km`` (great circle) with their ``dist_km``."""
    la_min, la_max, lo_min, lo_max = radius_box(lat0, lon0, r_km)
    near = within_box(df, la_min, la_max, lo_min, lo_max, lat, lon)
    return add_distance(near, lat0, lon0, lat, lon).filter(F.col("dist_km") <= r_km)


def nearest(df: DataFrame, lat0: float, lon0: float, r_km: float, n: int,
            key: str = "DR_NO") -> DataFrame:
    """The ``n`` nearest points within ``r_km``, nearest first (ties to the
    lowest key)."""
    return first_k_by(within_radius(df, lat0, lon0, r_km), "dist_km", n, [key])


# Cells of the whole globe for `nearest_rings`: 2^BITS along a circle of longitude at the finest level that every point gets.
BITS = 16
RINGS = 3          # rounds of growing cells before the cells that lie empty are skipped
FINEST = -14       # level of the smallest cells (4 cm) that crowded cells are cut into
LEAF_ROWS = 64     # points that the pieces of a crowded cell shall hold at most; up to 4 times as many stay together
BLOCK_ROWS = 1024  # a center meets the 3 x 3 cells around it as a whole if they hold no more points
TASK_CENTERS = 20_000  # cells of centers that meet the points of one cell in one task


def _globe_cells(lat: str, lon: str, level: int) -> list[F.Column]:
    """Cell indexes of a point ``level`` doublings above the finest cells: rows
    from the south pole (the north pole in the last), columns wrap."""
    size = 360.0 / (1 << (BITS - level))
    row = F.least(F.floor((F.col(lat) + 90.0) / size), F.lit((1 << (BITS - level)) // 2 - 1)).cast("int")
    col = F.pmod(F.floor((F.col(lon) + 180.0) / size), F.lit(1 << (BITS - level))).cast("int")
    return [row, col]


def _settled_km(lat0: F.Column, size: float, radius_km: float = EARTH_RADIUS_KM) -> F.Column:
    """A distance within which every point of the globe lies in the 3 x 3 cells
    of ``size`` degrees around a center (0 near the poles, where it needs all)."""
    edge = F.abs(lat0) + F.lit(size)
    narrow = F.cos(F.radians(F.least(edge, F.lit(90.0))))
    return F.when(edge < 89.9, F.lit(radius_km * math.radians(size) * 0.998) * narrow).otherwise(F.lit(0.0))


_CENTER = ["clat", "clon"]
_CELL = ["level", "r", "c"]


def _at_level(df: DataFrame, lat: str, lon: str, level: int) -> DataFrame:
    row, col = _globe_cells(lat, lon, level)
    return df.withColumns({"level": F.lit(level), "r": row, "c": col})


def _nearest_in(points: DataFrame, around: DataFrame, n: int, known_rows: int) -> DataFrame:
    """The ``n`` nearest points of each center among those in its cells
    (``around``: center, cell and ``within``, the distance in km beyond which
    points do not matter), each task keeping ``n`` of a center before the shuffle.  Cells hold a bounded number of points, so where ``around`` is too
    long to broadcast a cell's centers, if many, are dealt over tasks."""
    if known_rows <= MAX_BROADCAST_ROWS:
        met = join_small(points, around, _CELL, "inner", known_rows=known_rows)
    else:
        met = join_hot(around, points, _CELL, "inner", task_rows=TASK_CENTERS, salt_on=_CENTER)
    dist = X.haversine_km(F.col("clat"), F.col("clon"), "plat", "plon")
    near = met.select(*_CENTER, "key", "within", dist.alias("dist_km")).where(F.col("dist_km") <= F.col("within")).drop("within")
    return top_per_group(near, _CENTER, [F.col("dist_km"), F.col("key")], n, rank_col="rank")


def _can_hold(now: DataFrame, n: int) -> DataFrame:
    """Of the cells of each center (``now``: center, cell, points in it) those
    that can hold one of its ``n`` nearest points, with the distance ``within``
    which other cells hold ``n`` points for certain: those go whose nearest
    point must lie beyond it.

    By the haversine formula a cell's points lie within half its diagonal, taken
    flat, of its middle, which bounds their distances."""
    size = F.pow(F.lit(2.0), F.col("level") - F.lit(BITS)) * F.lit(360.0)
    mid = X.haversine_km(F.col("clat"), F.col("clon"), F.lit(-90.0) + (F.col("r") + 0.5) * size, F.lit(-180.0) + (F.col("c") + 0.5) * size)
    spread = F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.radians(size) / F.lit(2.0 * math.sqrt(2.0))))
    slack = F.when(F.col("mid") > 20_000.0, F.lit(1e-3)).otherwise(F.lit(1e-6))   # doubles resolve distances to the antipode less finely
    by_far = Window.partitionBy(*_CENTER).orderBy("far").rowsBetween(Window.unboundedPreceding, 0)
    held = (now.withColumn("mid", mid).withColumn("reach", spread + slack).withColumn("far", F.col("mid") + F.col("reach"))
            .withColumn("held", F.sum("n").over(by_far)))
    enough = F.min(F.when(F.col("held") >= n, F.col("far"))).over(Window.partitionBy(*_CENTER))
    within = F.coalesce(enough, F.lit(float("inf")))
    return held.withColumn("within", within).where(F.col("mid") - F.col("reach") <= F.col("within")).select(*_CENTER, *_CELL, "n", "within")


def _cells_at(cells: DataFrame, level: int) -> DataFrame:
    """(r, c, n) at ``level`` of the counted cells of this and finer levels."""
    up = lambda c: F.expr(f"shiftright({c}, {level} - level)").alias(c)
    return cells.where(F.col("level") <= level).select(up("r"), up("c"), "n").groupBy("r", "c").agg(F.sum("n").alias("n"))


def _quartered(now: DataFrame, cells: DataFrame, n_cells: int, level: int, n: int) -> DataFrame:
    """``now`` with its cells of the level above giving way to their quarters
    occupied by ``cells``, of all of which those stay that :func:`_can_hold`."""
    quarters = _cells_at(cells, level).select(F.lit(level + 1).alias("level"), F.shiftright("r", 1).alias("r"), F.shiftright("c", 1).alias("c"),
                           F.struct(F.lit(level).alias("level"), "r", "c", "n").alias("quarter"))
    cut = join_small(now, quarters, _CELL, "left", known_rows=min(n_cells, 1 << (2 * (BITS - level) - 1)))
    return _can_hold(cut.select(*_CENTER, F.coalesce("quarter", F.struct(*_CELL, "n")).alias("cell")).select(*_CENTER, "cell.*"), n)


def _occupied_near(points: DataFrame, cells: DataFrame, n_cells: int, centers: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(center, cell) of the occupied cells that can hold one of a center's
    ``n`` nearest points, and the points with their cell.

    From the globe down to level 0 each cell gives way to its occupied quarters
    that :func:`_can_hold`.  Those cells that are still crowded are counted
    again in cells as fine as their number of points asks for, and searched the
    same way, until every cell holds few points: so a center meets a bounded
    number of them however many there are in all.

    ``cells``: occupied cells of level 0 or finer with their number of points."""
    now = centers.withColumns({"level": F.lit(BITS), "r": F.lit(0), "c": F.lit(0), "n": F.lit(0).cast("long")})
    for level in range(BITS - 1, -1, -1):
        now = _quartered(now, cells, n_cells, level, n)
        if level % 4 == 0:
            now = reliable_checkpoint(now)
    row, col = _globe_cells("plat", "plon", FINEST)
    placed = _at_level(points, "plat", "plon", 0).withColumns({"fine_r": row, "fine_c": col})
    leaf = max(LEAF_ROWS, n)
    while True:
        halvings = F.least(F.ceil(F.log(F.col("n") / F.lit(leaf)) / F.lit(math.log(4.0))), F.col("level") - F.lit(FINEST)).cast("int")
        crowded = reliable_checkpoint(now.where((F.col("n") > 4 * leaf) & (F.col("level") > FINEST)).select(*_CELL, (F.col("level") - halvings).alias("deeper")).distinct())
        n_crowded, first, last = crowded.agg(F.count(F.lit(1)), F.max("level"), F.min("deeper")).first()
        if not n_crowded:
            return now, placed
        placed = join_small(placed, crowded, _CELL, "left", known_rows=n_crowded).withColumns({
            "cut": F.col("deeper").isNotNull(), "level": F.coalesce("deeper", "level")}).drop("deeper").withColumns(
                {c: F.expr(f"shiftright(fine_{c}, level - ({FINEST}))") for c in ("r", "c")})
        pieces = reliable_checkpoint(placed.where("cut").groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n")))
        placed, n_pieces = placed.drop("cut"), pieces.count()
        for level in range(first - 1, last - 1, -1):
            now = _quartered(now, pieces, n_pieces, level, n)
            if level % 4 == 0 or level == last:
                now = reliable_checkpoint(now)


def nearest_rings(points: DataFrame, centers: DataFrame, n: int, start_level: int = 0, key: str = "DR_NO", center_key: str = "center_id",
                  lat: str = "LAT_d", lon: str = "LON_d", center_lat: str = "center_lat", center_lon: str = "center_lon") -> DataFrame:
    """The ``n`` nearest points of every center, at any distance: (center,
    rank, key, dist_km), nearest first, ties to the lowest key.

    Centers look into the 3 x 3 cells around them by an equality join on the
    cell.  One whose n-th distance is below the cells' inner edge is done, the
    others look again in cells twice as wide, which holds all that was seen
    before.  A round's points are counted first: a center meets them if they
    are ``n`` to ``BLOCK_ROWS``.  Centers that ``RINGS`` rounds left open lie in
    sparse or in crowded country: for them the occupied cells are searched from
    the globe's halves down by equality joins on the parent cell, as deep as
    the points lie dense (:func:`_occupied_near`), so that they meet only
    points of cells that can hold a nearest one, however far.

    Defined cases: points and centers without finite coordinates, and centers
    without a key, take no part; centers that share a key and place count
    once; fewer than ``n`` points give all of them.

    Scale: of points at one place only the ``n`` lowest keys can be results,
    the others are dropped in one shuffle; a place of many centers is searched
    once.  A center meets a bounded number of points however dense they lie, so
    the work grows as points + centers.  Points are not moved while the open
    centers' cells are few (they are counted), else joined on the cell; the
    counted cells are bounded by geography and by points / ``LEAF_ROWS``."""
    finite = lambda a, b: (F.abs(F.col(a)) <= 90.0) & (F.abs(F.col(b)) <= 360.0)
    pts = points.where(finite(lat, lon) & F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col(lat).cast("double").alias("plat"), F.col(lon).cast("double").alias("plon"))
    pts = reliable_checkpoint(top_per_group(pts, ["plat", "plon"], [F.col("key")], n))
    asked = reliable_checkpoint(centers.where(finite(center_lat, center_lon) & F.col(center_key).isNotNull()).select(
        F.col(center_key).alias("center"), F.col(center_lat).cast("double").alias("clat"), F.col(center_lon).cast("double").alias("clon")).distinct())
    left = reliable_checkpoint(asked.select(*_CENTER).distinct())
    n_places = n_left = left.count()
    cells = reliable_checkpoint(_at_level(pts, "plat", "plon", min(start_level, 0)).groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n")))
    n_cells, out = cells.count(), None

    def add(found: DataFrame) -> None:
        nonlocal out
        out = found if out is None else out.unionByName(found)

    for level in range(start_level, min(start_level + RINGS, BITS - 1)):
        if not n_left:
            break
        size, placed = 360.0 / (1 << (BITS - level)), _at_level(pts, "plat", "plon", level)
        steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        around = _at_level(left, "clat", "clon", level).withColumn("s", F.explode(steps)).select(
            *_CENTER, "level", (F.col("r") + F.col("s.a")).alias("r"), F.pmod(F.col("c") + F.col("s.b"), F.lit(1 << (BITS - level))).alias("c")).distinct()
        counted = join_small(around, _cells_at(cells, level), ["r", "c"], "inner", known_rows=n_cells)
        held = F.sum("n").over(Window.partitionBy(*_CENTER))
        met = reliable_checkpoint(counted.withColumn("held", held).where(F.col("held").between(n, max(BLOCK_ROWS, 4 * n)))
                                  .select(*_CENTER, *_CELL, _settled_km(F.col("clat"), size).alias("within")))
        n_met = met.count()
        if not n_met:
            continue
        near = reliable_checkpoint(_nearest_in(placed, met, n, n_met))
        settled = near.groupBy(*_CENTER).agg(F.count(F.lit(1)).alias("found"), F.max("dist_km").alias("far"))
        settled = settled.where((F.col("found") >= n) & (F.col("far") < _settled_km(F.col("clat"), size))).select(*_CENTER)
        add(near.join(settled, _CENTER, "left_semi"))
        left = reliable_checkpoint(left.join(settled, _CENTER, "left_anti"))
        n_left = left.count()
    if out is None or n_left:
        around, placed = _occupied_near(pts, cells, n_cells, left, n)
        add(_nearest_in(placed, around.drop("n"), n, around.count()))
    return (join_small(asked, out, _CENTER, "inner", known_rows=n_places * n)
            .select(F.col("center").alias(center_key), "rank", F.col("key").alias(key), "dist_km"))


def hexbin(df: DataFrame, gridsize: int = 80,
           extent: tuple[float, float, float, float] = (-118.7, -118.15, 33.7, 34.35),
           x: str = "LON_d", y: str = "LAT_d", weight: str | None = None) -> DataFrame:
    """Point count per hexagon over ``extent`` = (xmin, xmax, ymin, ymax),
    all points (no sample); empty hexagons are not listed."""
    binned = df.select(x, y, *([weight] if weight else []))
    for step in X.hex_cell(x, y, gridsize, extent):
        binned = binned.withColumns(step)
    # "inside" depends on the bin keys only, so points outside the lattice
    # form bins of count 0 that are dropped after the aggregate; a filter
    # on the derived column would be pushed below the projections and
    # re-inline the whole bin computation.
    counts = (binned.groupBy("hex_lattice", "hex_col", "hex_row")
              .agg(F.sum(F.col("hex_inside").cast("long") * (F.col(weight) if weight else F.lit(1)))
                   .cast("long").alias("count"))
              .filter(F.col("count") > 0))
    cx, cy = X.hex_center("hex_lattice", "hex_col", "hex_row", gridsize, extent)
    return counts.withColumns({"hex_x": cx, "hex_y": cy})


def add_weight(df: DataFrame, use_log: bool = True, col: str = "count",
               out: str = "weight") -> DataFrame:
    """Map weight of a cell: ``log(1 + count)`` or the raw count."""
    return df.withColumn(out, F.log1p(col) if use_log else F.col(col).cast("double"))


MARKER_SIZES = {
    "log10": lambda c: F.lit(10.0) * F.log1p(c),
    "log8": lambda c: F.lit(8.0) * F.log1p(c),
    "sqrt": lambda c: F.sqrt(c),
}


def marker_size(df: DataFrame, kind: str = "log10", col: str = "count",
                out: str = "size") -> DataFrame:
    """Marker size from the count: 10*log1p, 8*log1p or sqrt."""
    return df.withColumn(out, MARKER_SIZES[kind](F.col(col)))


def stable_sample(df: DataFrame, key: str, fraction: float, seed: int, n: int | None = None) -> DataFrame:
    """Keep ``fraction`` of the rows by a threshold on a hash of ``key``: the
    same rows on every run and partitioning, whatever the keys' pattern.  With
    ``n``, at most the ``n`` rows of smallest hash, which is a sample too."""
    share = X.stable_share(key, seed)
    kept = df.filter(share < F.lit(float(fraction)))
    return kept if n is None else kept.orderBy(share, key).limit(n)


def map_points(df: DataFrame, n: int | None = None, key: str = "DR_NO", seed: int = 42) -> DataFrame:
    """Known points for a map: all of them, or an even sample of ``n``."""
    points = df.filter(F.col("LAT") != 0).select(key, "LAT", "LON", "Crm_Cd_Desc")
    return points if n is None else stable_sample(points, key, 1.0, seed, n)


def marker_label(df: DataFrame, text: str = "Crm_Cd_Desc", dist: str | None = None,
                 out: str = "label") -> DataFrame:
    """Popup text: the first 80 characters of ``text``; with a distance,
    the first 60, `` | `` and the distance with 2 decimals and ``km``."""
    if dist is None:
        return df.withColumn(out, F.substring(F.coalesce(F.col(text), F.lit("")), 1, 80))
    return df.withColumn(out, F.format_string(
        "%s | %.2f km", F.substring(F.coalesce(F.col(text), F.lit("")), 1, 60), F.col(dist)))
