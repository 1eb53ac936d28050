"""Fitted models: ridge regression of the monthly counts and k-means of the
hotspot cells, each with a DuckDB twin that fits the same model by other means
(elimination of the normal equations; unrolled rounds and all distances)."""

from __future__ import annotations

from ..operators import lloyd as L
from ..operators import model as M
from ..operators import ridge as RG
from ..operators import spatial as G
from . import frames as B
from .catalog import (
    _CLUSTER_INPUT_SQL,
    _FIXED_PRED_SQL,
    _SPLIT_SQL,
    FIXED_CENTERS,
    PANEL_KEYS,
    SCALE,
    _profile_sql,
    cluster_input_frame,
    r6,
    register,
    stored_panel,
)
from .oracle import PRELUDE, grid_i, lit, q

SEED = 42
K = 8

# ============================================================ ridge

_RIDGE_CTES = f""", panel AS (
  SELECT *, {_SPLIT_SQL} AS split FROM ({_profile_sql("enriched", PANEL_KEYS, rounded=False)})
), labels AS (
  SELECT list(spa ORDER BY n DESC, spa) AS ls FROM (SELECT spa, count(*) AS n FROM panel WHERE split = 'train' GROUP BY spa)
), design AS (
  SELECT p.*, list_transform(ls, lambda l: CASE WHEN l = p.spa THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
    || [avg_income::DOUBLE, avg_victim_age::DOUBLE, weapon_rate::DOUBLE, "Occured_Month"::DOUBLE, "Occured_Year"::DOUBLE] AS f
  FROM panel p, labels
), train AS (
  SELECT f, crime_count::DOUBLE AS y FROM design WHERE split = 'train'
), covs AS (
  SELECT i, j, covar_pop(f[i], f[j]) AS c FROM train, (SELECT unnest(range(1, len(f) + 1)) AS i FROM (SELECT f FROM train LIMIT 1)),
    (SELECT unnest(range(1, len(f) + 1)) AS j FROM (SELECT f FROM train LIMIT 1)) GROUP BY i, j
), rhs AS (
  SELECT i, covar_pop(f[i], y) AS c, avg(f[i]) AS m FROM train, (SELECT unnest(range(1, len(f) + 1)) AS i FROM (SELECT f FROM train LIMIT 1)) GROUP BY i
), spread AS (SELECT stddev_pop(y) AS sd, avg(y) AS my FROM train
), gj(k, m) AS (
  SELECT 1, (SELECT list(cells || [c] ORDER BY i) FROM (
    SELECT covs.i, list(covs.c + CASE WHEN covs.i = j THEN 0.1::DOUBLE * covs.c / sd + CASE WHEN covs.c = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
      ELSE 0.0::DOUBLE END ORDER BY j) AS cells FROM covs, spread GROUP BY covs.i) JOIN rhs USING (i))
  UNION ALL
  SELECT k + 1, list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 2), lambda j:
    CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END))
  FROM gj WHERE k <= len(m)
), beta AS (
  SELECT list_transform(m, lambda r: r[len(r)]) AS b FROM gj WHERE k = len(m) + 1
), fitted AS (
  SELECT b, my - list_sum(list_transform(range(1, len(b) + 1), lambda i: b[i] * means[i])) AS b0
  FROM beta, spread, (SELECT list(m ORDER BY i) AS means FROM rhs)
), pred AS (
  SELECT d.*, b0 + list_sum(list_transform(range(1, len(b) + 1), lambda i: b[i] * f[i])) AS prediction FROM design d, fitted WHERE split = 'test'
)"""


def _ridge_q(body: str) -> str:
    return PRELUDE.replace("WITH\n", "WITH RECURSIVE\n", 1) + _RIDGE_CTES + "\n" + body


def _ridge(spark, d):
    train, test = M.split_by_key(stored_panel(spark, d), PANEL_KEYS)
    model = RG.fit(train)
    return model, RG.predict(test, model)


@register("ridge_predictions", _ridge_q('SELECT spa, "Occured_Year", "Occured_Month", crime_count, round(prediction, 6) AS prediction FROM pred'))
def ridge_predictions(spark, d):
    return r6(_ridge(spark, d)[1].select(*PANEL_KEYS, "crime_count", "prediction"), "prediction")


@register("prediction_pairs", _ridge_q(
    "SELECT crime_count, round(prediction, 6) AS prediction, round(least(min(crime_count) OVER (), min(prediction) OVER ()), 6) AS range_lo, "
    "round(greatest(max(crime_count) OVER (), max(prediction) OVER ()), 6) AS range_hi FROM pred"))
def prediction_pairs(spark, d):
    return r6(M.prediction_pairs(_ridge(spark, d)[1]), "prediction", "range_lo", "range_hi")


@register("ridge_metrics", _ridge_q(
    "SELECT n, round(sqrt(sse / n), 6) AS rmse, round(1.0::DOUBLE - sse / (var * n), 6) AS r2 FROM (SELECT count(*) AS n, "
    "sum((crime_count - prediction) * (crime_count - prediction)) AS sse, var_pop(crime_count::DOUBLE) AS var FROM pred)"))
def ridge_metrics(spark, d):
    return r6(M.regression_metrics(_ridge(spark, d)[1]), "rmse", "r2")


@register("ridge_coefficients", _ridge_q(
    "SELECT CASE WHEN i <= len(ls) THEN 'spa_ohe_' || ls[i] ELSE (['avg_income', 'avg_victim_age', 'weapon_rate', 'Occured_Month', 'Occured_Year'])"
    "[i - len(ls)] END AS feature, round(b[i], 6) AS coefficient, round(abs(b[i]), 6) AS abs_coef "
    "FROM fitted, labels, (SELECT unnest(range(1, len(b) + 1)) AS i FROM fitted)"))
def ridge_coefficients(spark, d):
    panel = stored_panel(spark, d)
    model = RG.fit(M.split_by_key(panel, PANEL_KEYS)[0])
    return r6(RG.coefficient_table(panel, model), "coefficient", "abs_coef")


@register("ridge_residual_check", q("SELECT true AS residuals_sum_to_zero"))
def ridge_residual_check(spark, d):
    """A property, not the fit: an unpenalised intercept leaves training residuals of mean zero."""
    from pyspark.sql import functions as F

    train, _ = M.split_by_key(stored_panel(spark, d), PANEL_KEYS)
    pred = RG.predict(train, RG.fit(train))
    gap = F.abs(F.avg(F.col("crime_count") - F.col("prediction"))) <= F.lit(1e-6) * F.avg("crime_count")
    return pred.agg(gap.alias("residuals_sum_to_zero"))


# ============================================================ k-means

_KS = ", ".join(f"({k})" for k in L.KS)


def _fits_sql() -> str:
    """CTEs: the cells, k-means++ starts and every round's centers, the last
    being ``centers(k, cluster, lat, lon)`` and ``assigned(k, lat_i, lon_i, cluster)``."""
    top = max(L.KS)
    share = lambda j: (f"(('0x' || substr(md5(concat_ws('|', '{SEED + j}', CAST(lat_i AS VARCHAR), CAST(lon_i AS VARCHAR))), 1, 8))::BIGINT "  # noqa: E731
                       f"/ 4294967296.0::DOUBLE + {lit(2.0 ** -33)})")
    out = [f", cells AS MATERIALIZED ({_CLUSTER_INPUT_SQL})", "d0 AS MATERIALIZED (SELECT lat_i, lon_i, 1::BIGINT AS d2 FROM cells)"]
    for j in range(top):
        out.append(f"s{j} AS MATERIALIZED (SELECT lat_i, lon_i FROM d{j} WHERE d2 > 0 ORDER BY -ln({share(j)}) / d2, lat_i, lon_i LIMIT 1)")
        gap = f"(c.lat_i - s.lat_i) * (c.lat_i - s.lat_i) + (c.lon_i - s.lon_i) * (c.lon_i - s.lon_i)"
        least = gap if j == 0 else f"least(c.d2, {gap})"
        out.append(f"d{j + 1} AS MATERIALIZED (SELECT c.lat_i, c.lon_i, {least} AS d2 FROM d{j} c, s{j} s)")
    out.append("starts AS (" + " UNION ALL ".join(f"SELECT {j} AS cluster, lat_i / {SCALE}.0::DOUBLE AS lat, lon_i / {SCALE}.0::DOUBLE AS lon FROM s{j}"
                                                  for j in range(top)) + ")")
    out.append(f"r0 AS MATERIALIZED (SELECT k, cluster, lat, lon FROM (VALUES {_KS}) AS t(k), starts WHERE cluster < k)")
    near = ("SELECT k, lat_i, lon_i, arg_min(cluster, (d2, cluster)) AS cluster FROM (SELECT k, lat_i, lon_i, cluster, "
            "(lat_grid - lat) * (lat_grid - lat) + (lon_grid - lon) * (lon_grid - lon) AS d2 FROM cells, {r}) GROUP BY k, lat_i, lon_i")
    for i in range(L.ROUNDS):
        out.append(f"r{i + 1} AS MATERIALIZED (SELECT p.k, p.cluster, coalesce(m.lat, p.lat) AS lat, coalesce(m.lon, p.lon) AS lon FROM r{i} p LEFT JOIN ("
                   f"SELECT k, cluster, CAST(sum(lat_i) AS DOUBLE) / count(*) / {SCALE}.0::DOUBLE AS lat, CAST(sum(lon_i) AS DOUBLE) / count(*) / {SCALE}.0::DOUBLE "
                   f"AS lon FROM ({near.format(r=f'r{i}')}) GROUP BY k, cluster) m USING (k, cluster))")
    out.append(f"assigned AS MATERIALIZED ({near.format(r=f'r{L.ROUNDS}')})")
    return ", ".join(out)


_FITS = _fits_sql()


def _silhouette_sql(labelled: str, by: str = "k") -> str:
    """Mean silhouette per k of (k, lat_i, lon_i, cluster), cluster moments as rows."""
    return f"""SELECT {by}, round(avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0.0::DOUBLE ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM (
  SELECT x.k, x.lat_i, x.lon_i, min(CASE WHEN c.cluster = x.cluster THEN c.n END) AS n,
         min(CASE WHEN c.cluster = x.cluster THEN far / greatest(c.n - 1, 1) END) AS a, min(CASE WHEN c.cluster <> x.cluster THEN far / c.n END) AS b
  FROM ({labelled}) x JOIN (SELECT k, cluster, count(*) AS n, CAST(sum(lat_i) AS BIGINT) AS y, CAST(sum(lon_i) AS BIGINT) AS x,
         CAST(sum(lat_i * lat_i + lon_i * lon_i) AS BIGINT) AS q FROM ({labelled}) GROUP BY k, cluster) c ON x.k = c.k,
    LATERAL (SELECT CAST(c.n * (x.lat_i * x.lat_i + x.lon_i * x.lon_i) - 2 * (x.lat_i * c.y + x.lon_i * c.x) + c.q AS DOUBLE) AS far)
  GROUP BY x.k, x.lat_i, x.lon_i) GROUP BY {by}"""


_ASSIGNED = "SELECT k, lat_i, lon_i, cluster FROM assigned"
_CELLS_K = f"(SELECT c.*, CAST(a.cluster AS INTEGER) AS prediction FROM cells c JOIN assigned a USING (lat_i, lon_i) WHERE a.k = {K})"


def _fit(spark, d, ks=(K,)):
    cells = M.fit_input(cluster_input_frame(spark, d))
    return cells, L.fit(cells, ks, SCALE, SEED)


@register("kmeans_cells", q(f"SELECT * FROM {_CELLS_K}", _FITS))
def kmeans_cells(spark, d):
    cells, fits = _fit(spark, d)
    return L.assign(cells, fits[K])


@register("cluster_centers", q(f"SELECT CAST(cluster AS INTEGER) AS cluster, round(lat, 6) AS center_lat, round(lon, 6) AS center_lon "
                               f"FROM r{L.ROUNDS} WHERE k = {K}", _FITS))
def cluster_centers(spark, d):
    cells, fits = _fit(spark, d)
    return r6(L.center_table(cells, fits[K]), "center_lat", "center_lon")


@register("cluster_summary", q(
    f"SELECT prediction, count(*) AS num_cells, CAST(sum(count) AS BIGINT) AS total_crimes_in_cells, round(avg(lat_grid), 6) AS center_lat, "
    f"round(avg(lon_grid), 6) AS center_lon FROM {_CELLS_K} GROUP BY prediction", _FITS))
def cluster_summary(spark, d):
    cells, fits = _fit(spark, d)
    return r6(M.cluster_summary(L.assign(cells, fits[K])), "center_lat", "center_lon")


@register("silhouette", q(f"SELECT CAST(k AS INTEGER) AS k, silhouette FROM ({_silhouette_sql(_ASSIGNED)}) WHERE k = {K}", _FITS))
def silhouette(spark, d):
    cells, fits = _fit(spark, d)
    return r6(L.silhouettes(cells, fits), "silhouette")


@register("silhouette_sweep", q(f"SELECT CAST(k AS INTEGER) AS k, silhouette FROM ({_silhouette_sql(_ASSIGNED)})", _FITS))
def silhouette_sweep(spark, d):
    cells, fits = _fit(spark, d, L.KS)
    return r6(L.silhouettes(cells, fits), "silhouette")


@register("centers_sweep", q(f"SELECT CAST(k AS INTEGER) AS k, CAST(cluster AS INTEGER) AS cluster, round(lat, 6) AS center_lat, "
                             f"round(lon, 6) AS center_lon FROM r{L.ROUNDS}", _FITS))
def centers_sweep(spark, d):
    """The centers of every k of the sweep."""
    cells, fits = _fit(spark, d, L.KS)
    rows = [(k, i, float(a), float(b)) for k, c in fits.items() for i, (a, b) in enumerate(c)]
    return r6(spark.createDataFrame(rows, "k int, cluster int, center_lat double, center_lon double"), "center_lat", "center_lon")


_FIXED_K = f"SELECT {len(FIXED_CENTERS)} AS k, lat_i, lon_i, prediction AS cluster FROM ({_FIXED_PRED_SQL})"


@register("silhouette_fixed", q(
    f"SELECT CAST((SELECT count(DISTINCT cluster) FROM ({_FIXED_K})) AS INTEGER) AS k, silhouette FROM ({_silhouette_sql(_FIXED_K)})"))
def silhouette_fixed(spark, d):
    """Silhouette of the assignment to given centers."""
    return r6(L.silhouette_of(M.fit_input(M.assign_nearest(cluster_input_frame(spark, d), FIXED_CENTERS))), "silhouette")


@register("kmeans_assignment_check", q(f"SELECT count(*) AS n_cells, CAST(0 AS BIGINT) AS n_wrong FROM ({_CLUSTER_INPUT_SQL})"))
def kmeans_assignment_check(spark, d):
    """A property, not the fit: every cell of the fitted k-means lies nearest to its own center."""
    from pyspark.sql import functions as F

    cells, fits = _fit(spark, d)
    pred, centers = L.assign(cells, fits[K]), fits[K]
    d2 = lambda c: (F.col("lat_grid") - c[0]) * (F.col("lat_grid") - c[0]) + (F.col("lon_grid") - c[1]) * (F.col("lon_grid") - c[1])
    own = F.coalesce(*[F.when(F.col("prediction") == i, d2(c)) for i, c in enumerate(centers)])
    wrong = F.count_if(own > F.least(*[d2(c) for c in centers]) + 1e-12)
    return pred.agg(F.count(F.lit(1)).alias("n_cells"), wrong.alias("n_wrong"))


# ============================================================ grid scales in one scan

_SCALES = (1000, 500, 200)


@register("hotspots_pyramid", q(" UNION ALL ".join(
    f'SELECT CAST({s} AS INTEGER) AS scale, lat_i, lon_i, count, lat_i / {s}.0::DOUBLE AS lat_grid, lon_i / {s}.0::DOUBLE AS lon_grid FROM (SELECT '
    f'{grid_i(chr(34) + "LAT_d" + chr(34), s)} AS lat_i, {grid_i(chr(34) + "LON_d" + chr(34), s)} AS lon_i, count(*) AS count FROM geo GROUP BY 1, 2)'
    for s in _SCALES)))
def hotspots_pyramid(spark, d):
    """The report's three grid scales from one scan."""
    return G.cell_pyramid(B.geo(spark, d), _SCALES)
