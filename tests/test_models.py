"""Ridge from sufficient statistics, k-means for many k, silhouettes from moments, the cell pyramid."""

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import functions as F

from tractscope.operators import lloyd as L
from tractscope.operators import model as M
from tractscope.operators import ridge as RG
from tractscope.operators import spatial as G
from tractscope.operators import summary as A
from tractscope.plans import frames as B
from tractscope.plans.catalog import PANEL_KEYS, cluster_input_frame
from tractscope.plans.registry import CATALOG

SF = "/root/testdata/sf0.001"
COLUMNS = "spa string, Occured_Year int, Occured_Month int, crime_count long, avg_income double, avg_victim_age double, weapon_rate double"


def panel(spark, n=300, seed=3, **fixed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        region = "ABCD"[int(rng.integers(0, 4)) if rng.random() < 0.6 else 0]
        r = dict(spa=region, Occured_Year=int(rng.integers(2015, 2025)), Occured_Month=int(rng.integers(1, 13)),
                 crime_count=int(rng.integers(0, 90) + 40 * (region == "B")), avg_income=50_000.0 + 9_000 * "ABCD".index(region),
                 avg_victim_age=float(rng.normal(38, 3)), weapon_rate=float(rng.random())) | fixed
        rows.append(tuple(r.values()))
    return spark.createDataFrame(rows, COLUMNS).repartition(5)


def assert_equals_mllib(train):
    ours, theirs = RG.fit(train), M.fit_count_model(train).stages[-1]
    assert np.allclose(ours.coefficients, theirs.coefficients.toArray(), rtol=1e-6, atol=1e-8)
    assert abs(ours.intercept - theirs.intercept) < 1e-6 * max(1.0, abs(theirs.intercept))


def test_ridge_equals_mllib(spark):
    assert_equals_mllib(panel(spark))
    assert_equals_mllib(panel(spark, Occured_Month=7))                       # a constant feature
    stored = A.region_month_panel(B.enriched(spark, SF))
    train, test = M.split_by_key(stored, PANEL_KEYS)
    assert_equals_mllib(train)
    pred = M.fit_count_model(train).transform(test).select(*PANEL_KEYS, F.col("prediction").alias("theirs"))
    both = RG.predict(test, RG.fit(train)).join(pred, PANEL_KEYS).select("prediction", "theirs").collect()
    assert both and all(abs(r.prediction - r.theirs) < 1e-6 for r in both)
    names = [r.feature for r in M.coefficient_table(M.fit_count_model(train), M.fit_count_model(train).transform(test)).collect()]
    assert sorted(names) == sorted(r.feature for r in RG.coefficient_table(train, RG.fit(train)).collect())


def test_ridge_of_odd_rows(spark):
    df = panel(spark, 60)
    nulls = spark.createDataFrame([(None, 2020, 1, 5, 1.0, 1.0, 1.0), ("A", 2020, 1, None, 1.0, 1.0, 1.0), ("A", 2020, 1, 5, None, 1.0, 1.0)], df.schema)
    assert np.allclose(RG.fit(df.unionByName(nulls)).coefficients, RG.fit(df).coefficients)
    flat = RG.fit(panel(spark, 40, crime_count=9))
    assert set(flat.coefficients) == {0.0} and flat.intercept == 9.0
    assert RG.fit(df.limit(0)) is None
    model = RG.fit(df)
    new = spark.createDataFrame([("ZZ", 2020, 1, 5, 60_000.0, 38.0, 0.5)], df.schema)
    known = spark.createDataFrame([("A", 2020, 1, 5, 60_000.0, 38.0, 0.5)], df.schema)
    a, z = RG.predict(known, model).first().prediction, RG.predict(new, model).first().prediction
    assert abs((a - z) - model.coefficients[model.labels.index("A")]) < 1e-9


def test_ridge_reads_one_row_per_region(spark):
    train = panel(spark, 5000)
    assert RG.statistics(train).count() == 4


# ---------------------------------------------------------------- k-means


def cells_of(spark, points, scale=500):
    rows = [(int(a), int(b), 1, a / scale, b / scale) for a, b in points]
    return spark.createDataFrame(rows, "lat_i long, lon_i long, count long, lat_grid double, lon_grid double").repartition(4)


def blobs(n=400, seed=5):
    rng = np.random.default_rng(seed)
    mid = np.array([[17000, -59000], [17080, -59100], [16950, -59200], [17100, -58900]])
    return sorted({(int(a), int(b)) for a, b in np.round(mid[rng.integers(0, 4, n)] + rng.normal(scale=14, size=(n, 2)))})


def test_rounds_against_numpy(spark):
    points = blobs()
    cells = cells_of(spark, points)
    fits = L.fit(cells, (3, 4, 7))
    x = np.array(points) / 500.0
    for k, centers in fits.items():
        start = L.start_cells(cells, 7)[:k]
        c = np.array(start) / 500.0
        for _ in range(L.ROUNDS):
            near = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(k)])
        assert np.allclose(centers, c, atol=1e-9)
        got = {(r.lat_i, r.lon_i): r.prediction for r in L.assign(cells, centers).collect()}
        assert [got[p] for p in points] == near.tolist()


def test_starts_spread_and_do_not_depend_on_partitioning(spark):
    cells = cells_of(spark, blobs())
    starts = [L.start_cells(cells.repartition(n), 5) for n in (1, 7)]
    assert starts[0] == starts[1] and len(set(starts[0])) == 5
    assert L.start_cells(cells, 3) == starts[0][:3]
    assert len(L.start_cells(cells_of(spark, [(1, 1), (2, 2), (2, 2)]), 5)) == 2
    assert L.start_cells(cells.limit(0), 3) == []


def test_silhouettes_equal_mllib(spark):
    cells = cells_of(spark, blobs())
    fits = L.fit(cells, (2, 4, 6))
    ours = {r.k: r.silhouette for r in L.silhouettes(cells, fits).collect()}
    for k, centers in fits.items():
        labelled = L.assign(cells, centers)
        theirs = ClusteringEvaluator(featuresCol="features", metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(
            M.assemble_cells(labelled))
        one = L.silhouette_of(labelled).first()
        assert abs(ours[k] - theirs) < 1e-9 and abs(one.silhouette - theirs) < 1e-9 and one.k == k


def test_few_cells_and_one_cluster(spark):
    two = cells_of(spark, [(10, 10), (10, 40)])
    fits = L.fit(two, (1, 2, 5))
    assert [len(c) for c in fits.values()] == [1, 2, 2]
    scores = {r.k: r.silhouette for r in L.silhouettes(two, fits).collect()}
    assert scores == {1: None, 2: 0.0, 5: 0.0}
    none = two.limit(0)
    assert L.fit(none, (3,)) == {3: []} and L.silhouettes(none, {3: []}).count() == 0 and L.assign(none, []).count() == 0
    assert L.silhouette_of(L.assign(none, [])).count() == 0


def test_the_sweep_takes_tens_of_jobs(spark):
    cells = M.fit_input(cluster_input_frame(spark, SF))
    sc = spark.sparkContext
    sc.setJobGroup("sweep", "sweep")
    try:
        assert L.silhouettes(cells, L.fit(cells)).count() == len(L.KS)
        jobs = len(sc.statusTracker().getJobIdsForGroup("sweep"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 90


# ---------------------------------------------------------------- pyramid


def test_pyramid_equals_direct_counts_on_cell_edges(spark):
    rng = np.random.default_rng(2)
    edges = [i / s for s in (200, 500, 1000) for i in (-23_701, -7, 0, 6_767, 17_001, 34_033)]
    near = [float(np.nextafter(e, w)) for e in edges for w in (-1e9, 1e9)]
    values = edges + near + rng.uniform(-120, 40, 300).round(3).tolist()
    rows = [(a, float(rng.choice(values)), int(rng.integers(1, 4))) for a in values for _ in range(3)] + [(None, 1.0, 1), (float("nan"), 1.0, 1)]
    df = spark.createDataFrame(rows, "LAT_d double, LON_d double, w long").repartition(3)
    for weight in (None, "w"):
        got = G.cell_pyramid(df, weight=weight)
        for s in (1000, 500, 200):
            want = G.hotspots(df, s, weight=weight).collect()
            mine = got.where(F.col("scale") == s).drop("scale").select("lat_i", "lon_i", "count", "lat_grid", "lon_grid").collect()
            assert sorted(map(tuple, mine), key=str) == sorted(map(tuple, want), key=str)
    with pytest.raises(ValueError):
        G.cell_pyramid(df, (1000, 300))


def test_pyramid_reads_the_points_once(spark):
    plan = CATALOG["hotspots_pyramid"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("orders.parquet") == 1


def test_fractions_of_a_split(spark):
    df = spark.range(100_000).withColumnRenamed("id", "key")
    for fraction in (0.004, 0.5, 0.995):
        share = M.assign_split(df, ["key"], fraction).where("split = 'train'").count() / 100_000
        assert abs(share - fraction) < 0.0015
