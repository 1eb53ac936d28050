"""K-means of grid cells for many k at once, and its silhouette.

* **Start.** k-means++ with stable randomness: the j-th center is drawn with
  probability proportional to the squared distance from the nearest of the
  earlier ones, as the cell of least ``-ln(u) / d2`` where u is a hash of the
  cell and j.  The first k of the drawn centers start the fit of k clusters.
* **Rounds.** One aggregate per round over (k, cluster) for all k together:
  every cell meets the centers of all k in one projection.  Sums run over
  integer cell indexes, so a round's centers do not depend on partitioning and
  the fit ends exactly when no center moves (or after ``ROUNDS``).  A cluster
  without cells keeps its center.
* **Silhouette.** From each cluster's count, sum and square sum: the mean
  squared distance of a cell to a cluster is a formula of those, exact in
  integers until its one division, so no pair of cells is formed.

Cells need ``lat_i``, ``lon_i`` and ``lat_grid``, ``lon_grid`` (index / scale).
Defined cases: equal cells count once each; fewer distinct cells than k give
fewer centers; no cells give no center and an empty result; a cluster of one
cell has silhouette 0 there, and one cluster alone none (null).

Scale: cells are bounded by geography and written once (``model.fit_input``);
each round is one pass with at most sum(k) rows shuffled per task and brought
to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X

# The ks of the sweep.
KS = (3, 4, 5, 6, 7, 8, 9, 10, 12)
ROUNDS = 20
Centers = list[tuple[float, float]]
_Y, _X = "'y'", "'x'"


def _d2(center: tuple[float, float]) -> Column:
    """Squared distance in degrees from a cell to a center."""
    dy, dx = F.col("lat_grid") - F.lit(float(center[0])), F.col("lon_grid") - F.lit(float(center[1]))
    return dy * dy + dx * dx


def _i2(cell: tuple[int, int]) -> Column:
    """Squared distance in cells, exact."""
    dy, dx = F.col("lat_i") - F.lit(cell[0]), F.col("lon_i") - F.lit(cell[1])
    return dy * dy + dx * dx


def start_cells(cells: DataFrame, k: int, seed: int = 42) -> list[tuple[int, int]]:
    """Up to ``k`` cells by k-means++, one small job each."""
    chosen: list[tuple[int, int]] = []
    for j in range(k):
        u = X.stable_share(["lat_i", "lon_i"], seed + j) + F.lit(2.0 ** -33)  # never 0
        d2 = F.least(*[_i2(c) for c in chosen]) if len(chosen) > 1 else _i2(chosen[0]) if chosen else F.lit(1).cast("long")
        race = F.min(F.struct((-F.ln(u) / F.col("d2")).alias("race"), "lat_i", "lon_i"))
        best = cells.select("lat_i", "lon_i", d2.alias("d2")).where("d2 > 0").agg(race.alias("best")).first()["best"]
        if best is None:
            break
        chosen.append((best["lat_i"], best["lon_i"]))
    return chosen


def nearest(centers: Centers) -> Column:
    """The id of the nearest center, ties to the lowest."""
    candidates = [F.struct(_d2(c).alias("d2"), F.lit(i).alias("id")) for i, c in enumerate(centers)]
    return (F.least(*candidates) if len(candidates) > 1 else candidates[0]).getField("id")


def _nearest_of_each(cells: DataFrame, fits: Mapping[int, Centers]) -> DataFrame:
    """(lat_i, lon_i, k, cluster): every cell's nearest center under every k.

    The centers are one literal array, so the generated code does not grow with
    them and is compiled once for all rounds."""
    arrays = ", ".join(f"named_struct('k', {k}, 'c', array({', '.join(f'named_struct({_Y}, {a!r}D, {_X}, {b!r}D)' for a, b in c)}))"
                       for k, c in fits.items())
    each = cells.select("lat_i", "lon_i", "lat_grid", "lon_grid", F.expr(f"explode(array({arrays}))").alias("f"))
    near = ("array_min(transform(f.c, (c, i) -> named_struct('d2', (lat_grid - c.y) * (lat_grid - c.y) + (lon_grid - c.x) * (lon_grid - c.x), "
            "'id', i))).id")
    return each.selectExpr("lat_i", "lon_i", "f.k AS k", f"{near} AS cluster")


def fit(cells: DataFrame, ks: Sequence[int] = KS, scale: int = 500, seed: int = 42, rounds: int = ROUNDS) -> dict[int, Centers]:
    """The centers (lat, lon) of every k, from stored cells."""
    first = start_cells(cells, max(ks, default=0), seed)
    fits: dict[int, Centers] = {k: [(a / scale, b / scale) for a, b in first[:k]] for k in ks}
    if not first:
        return fits
    moving = set(ks)
    for _ in range(rounds):
        todo = {k: fits[k] for k in ks if k in moving}
        if not todo:
            break
        sums = _nearest_of_each(cells, todo).groupBy("k", "cluster").agg(
            F.count("*").alias("n"), F.sum("lat_i").alias("y"), F.sum("lon_i").alias("x")).collect()
        moved = {k: list(c) for k, c in todo.items()}
        for r in sums:
            moved[r["k"]][r["cluster"]] = (r["y"] / r["n"] / scale, r["x"] / r["n"] / scale)
        moving = {k for k in todo if moved[k] != todo[k]}
        fits.update(moved)
    return fits


def assign(cells: DataFrame, centers: Centers, out: str = "prediction") -> DataFrame:
    return cells.withColumn(out, nearest(centers) if centers else F.lit(None).cast("int"))


def center_table(cells: DataFrame, centers: Centers) -> DataFrame:
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(centers)]
    return cells.sparkSession.createDataFrame(rows, "cluster int, center_lat double, center_lon double")


def moments(labelled: DataFrame, by: Sequence[str] = ("k", "cluster")) -> DataFrame:
    """Per cluster: cells, sums and square sums of their indexes."""
    return labelled.groupBy(*by).agg(F.count("*").alias("n"), F.sum("lat_i").alias("y"), F.sum("lon_i").alias("x"),
                                     F.sum(F.col("lat_i") * F.col("lat_i") + F.col("lon_i") * F.col("lon_i")).alias("q"))


_SQUARE = "lat_i * lat_i + lon_i * lon_i"
#: Sum of the squared distances (in cells) to the members of cluster ``c``, exact.
_FAR = f"CAST(c.n * ({_SQUARE}) - 2L * (lat_i * c.y + lon_i * c.x) + c.q AS DOUBLE)"


def _scores(labelled: DataFrame, stats: Mapping[int, Sequence[Mapping[str, int]]]) -> DataFrame:
    """(k, score) of rows (lat_i, lon_i, k, cluster), the clusters' moments being a literal."""
    def of(clusters: Sequence[Mapping[str, int]]) -> str:
        return ", ".join(f"named_struct('id', {c['cluster']}, 'n', {c['n']}L, {_Y}, {c['y']}L, {_X}, {c['x']}L, 'q', {c['q']}L)" for c in clusters)

    known = ", ".join(f"{k}, array({of(c)})" for k, c in stats.items())
    rows = labelled.selectExpr("lat_i", "lon_i", "k", "cluster", f"element_at(map({known}), k) AS m")
    rows = rows.selectExpr("lat_i", "lon_i", "k", "filter(m, c -> c.id = cluster)[0] AS c", "filter(m, c -> c.id <> cluster) AS others")
    far = rows.selectExpr("k", "c.n AS n", f"{_FAR} / greatest(c.n - 1, 1) AS a", f"array_min(transform(others, c -> {_FAR} / c.n)) AS b")
    return far.selectExpr("k", "CASE WHEN b IS NULL THEN NULL WHEN n = 1 OR greatest(a, b) = 0 THEN 0D ELSE (b - a) / greatest(a, b) END AS score")


def silhouettes(cells: DataFrame, fits: Mapping[int, Centers]) -> DataFrame:
    """(k, silhouette) of every fit: one aggregate of moments, one of scores."""
    fits = {k: c for k, c in fits.items() if c}
    if not fits:
        return cells.sparkSession.createDataFrame([], "k int, silhouette double")
    labelled = _nearest_of_each(cells, fits)
    stats: dict[int, list[dict]] = {k: [] for k in fits}
    for r in moments(labelled).collect():
        stats[r["k"]].append(r.asDict())
    return _scores(labelled, stats).groupBy("k").agg(F.avg("score").alias("silhouette"))


def silhouette_of(labelled: DataFrame, cluster: str = "prediction") -> DataFrame:
    """(k, silhouette) of cells that carry their cluster; k counts the clusters met."""
    rows = labelled.select("lat_i", "lon_i", F.lit(0).alias("k"), F.col(cluster).alias("cluster"))
    stats = [r.asDict() for r in moments(rows).collect()]
    if not stats:
        return labelled.sparkSession.createDataFrame([], "k int, silhouette double")
    return _scores(rows, {0: stats}).agg(F.avg("score").alias("silhouette")).select(F.lit(len(stats)).alias("k"), "silhouette")
