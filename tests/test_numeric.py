"""Numeric checks of the model operators."""

import numpy as np
from pyspark.ml.regression import LinearRegression
from pyspark.ml.feature import VectorAssembler

from tractscope.operators import model as M


def test_assign_nearest_matches_kmeans(spark):
    rng = np.random.default_rng(3)
    pts = [(float(a), float(b), 1) for a, b in rng.normal(size=(300, 2)) * [0.2, 0.3] + [34.0, -118.3]]
    cells = spark.createDataFrame(pts, "lat_grid double, lon_grid double, count long")
    model, pred = M.cluster_cells(cells, k=5, seed=1)
    centers = [tuple(c) for c in model.clusterCenters()]
    ours = M.assign_nearest(cells, centers, out="ours")
    joined = pred.join(ours, ["lat_grid", "lon_grid", "count"])
    assert joined.filter("prediction != ours").count() == 0


def test_least_squares_matches_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 3))
    y = x @ np.array([1.5, -2.0, 0.5]) + 3.0 + rng.normal(scale=0.01, size=200)
    rows = [tuple(map(float, r)) + (float(t),) for r, t in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    vec = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    lr = LinearRegression(featuresCol="features", labelCol="y", regParam=0.0).fit(vec)
    design = np.c_[x, np.ones(len(x))]
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    assert np.allclose(list(lr.coefficients) + [lr.intercept], beta, atol=1e-6)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "crime_count double, prediction double")
    r = M.regression_metrics(df).first()
    assert abs(r.rmse - np.sqrt(2 / 3)) < 1e-12 and abs(r.r2 - 0.0) < 1e-12


def test_split_is_stable(spark):
    df = spark.range(500).selectExpr("cast(id as string) as spa", "1997 as Occured_Year", "7 as Occured_Month")
    a = M.assign_split(df, ["spa", "Occured_Year", "Occured_Month"]).collect()
    b = M.assign_split(df.repartition(7), ["spa", "Occured_Year", "Occured_Month"]).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    share = sum(r.split == "train" for r in a) / len(a)
    assert 0.7 < share < 0.9


def test_panel_ridge_matches_closed_form(spark):
    """The registered ridge model (regParam 0.1, standardization on) equals
    argmin 1/(2n)|y - Xb - b0|^2 + (lambda/2) sum (sd_j^2 / sd_y) b_j^2 with
    population standard deviations; zero-variance features get 0."""
    from tractscope.operators import summary as A
    from tractscope.plans import frames as B

    panel = A.region_month_panel(B.enriched(spark, "/root/testdata/sf0.001"))
    train, _ = M.split_by_key(panel, ["spa", "Occured_Year", "Occured_Month"])
    model = M.fit_count_model(train)
    rows = model.transform(train).select("features", "crime_count").collect()
    X = np.array([r.features.toArray() for r in rows])
    y = np.array([float(r.crime_count) for r in rows])
    n = len(y)
    sx, sy = X.std(axis=0), y.std()
    live = sx > 0
    Xc, yc = X[:, live] - X[:, live].mean(0), y - y.mean()
    A_ = Xc.T @ Xc / n + 0.1 * np.diag(sx[live] ** 2 / sy)
    b = np.zeros(X.shape[1])
    b[live] = np.linalg.solve(A_, Xc.T @ yc / n)
    b0 = y.mean() - X.mean(0) @ b
    lr = model.stages[-1]
    assert np.allclose(lr.coefficients.toArray(), b, rtol=1e-6, atol=1e-8)
    assert abs(lr.intercept - b0) < 1e-6 * max(1.0, abs(b0))


def test_silhouette_matches_brute_force(spark):
    """Silhouette of the registered k-means (k 8, seed 42) on the top cells
    equals the textbook definition with squared Euclidean distances."""
    from tractscope.plans.catalog import cluster_input_frame

    _, pred = M.cluster_cells(cluster_input_frame(spark, "/root/testdata/sf0.001"), k=8, seed=42)
    rows = pred.select("lat_grid", "lon_grid", "prediction").collect()
    P = np.array([[r.lat_grid, r.lon_grid] for r in rows])
    lab = np.array([r.prediction for r in rows])
    D = ((P[:, None, :] - P[None, :, :]) ** 2).sum(-1)
    scores = []
    for i in range(len(P)):
        own = lab == lab[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == c].mean() for c in set(lab.tolist()) if c != lab[i])
        scores.append((b - a) / max(a, b))
    assert abs(M.silhouette(pred) - float(np.mean(scores))) < 1e-9


def test_hexbin_matches_numpy_two_lattice_rule(spark):
    """Hexagon counts equal a NumPy version of the two-lattice rule: each
    point goes to the nearer of its lattice-A center (rounded indexes) and
    lattice-B center (floored + 1/2), distances with y scaled by sqrt 3."""
    from tractscope.operators import spatial as G
    from tractscope.plans import frames as B

    extent = (-118.7, -118.15, 33.7, 34.35)
    geo = B.geo(spark, "/root/testdata/sf0.001").select("LON_d", "LAT_d")
    pts = np.array([(r.LON_d, r.LAT_d) for r in geo.collect()])
    nx = 80
    ny = int(nx / np.sqrt(3))
    sx = (extent[1] - extent[0]) / nx
    sy = (extent[3] - extent[2]) / ny
    ix = (pts[:, 0] - extent[0]) / sx
    iy = (pts[:, 1] - extent[2]) / sy
    a = np.floor(ix + 0.5), np.floor(iy + 0.5)
    b = np.floor(ix), np.floor(iy)
    d1 = (ix - a[0]) ** 2 + 3.0 * (iy - a[1]) ** 2
    d2 = (ix - b[0] - 0.5) ** 2 + 3.0 * (iy - b[1] - 0.5) ** 2
    first = d1 < d2
    want: dict[tuple, int] = {}
    for i in range(len(pts)):
        if first[i]:
            key, ok = (0, int(a[0][i]), int(a[1][i])), 0 <= a[0][i] <= nx and 0 <= a[1][i] <= ny
        else:
            key, ok = (1, int(b[0][i]), int(b[1][i])), 0 <= b[0][i] < nx and 0 <= b[1][i] < ny
        if ok:
            want[key] = want.get(key, 0) + 1
    got = {(r.hex_lattice, r.hex_col, r.hex_row): r["count"] for r in G.hexbin(geo, 80, extent).collect()}
    assert got == want


def test_regression_metrics_match_mllib_evaluator(spark):
    from pyspark.ml.evaluation import RegressionEvaluator

    from tractscope.operators import summary as A
    from tractscope.plans import frames as B

    panel = A.region_month_panel(B.enriched(spark, "/root/testdata/sf0.001"))
    train, test = M.split_by_key(panel, ["spa", "Occured_Year", "Occured_Month"])
    pred = M.fit_count_model(train).transform(test)
    ours = M.regression_metrics(pred).first()
    ev = RegressionEvaluator(labelCol="crime_count", predictionCol="prediction")
    assert abs(ours.rmse - ev.setMetricName("rmse").evaluate(pred)) < 1e-9
    assert abs(ours.r2 - ev.setMetricName("r2").evaluate(pred)) < 1e-9
