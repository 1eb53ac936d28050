"""Hot-key joins, rankings without a task per group, nearest points of a table of centers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tractscope.operators import rank as R
from tractscope.operators import spatial as G
from tractscope.operators.joins import hot_keys, join_hot, replicated
from tractscope.plans import frames as B

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def skewed(spark, n=9000):
    """A third of the rows hold one key, a tenth none."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise((F.col("id") % 40).cast("string"))
    return spark.range(n).select(F.col("id").alias("v"), key.alias("k"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_hot_join_equals_a_plain_join(spark, how):
    big = skewed(spark)
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("3", 5), (None, 7)], "k string, w int")
    assert rows_of(join_hot(big, small, "k", how, task_rows=500)) == rows_of(big.join(small, "k", how))


def test_only_rows_of_hot_keys_are_copied(spark):
    big, small = skewed(spark), spark.range(5000).select((F.col("id") % 45).cast("string").alias("k"), F.col("id").alias("w"))
    small = small.unionByName(spark.createDataFrame([("hot", 1), ("hot", 2)], "k string, w long"))
    hot = hot_keys(big.na.drop(subset=["k"]), ["k"], 500)
    assert [(r.k, r["__slices"]) for r in hot.collect()] == [("hot", 6)]
    assert replicated(small, hot, ["k"]).count() == small.count() + 2 * 5


def test_hot_rows_are_spread_over_tasks(spark):
    big, small = skewed(spark), spark.createDataFrame([("hot", 1)], "k string, w int")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("false", "-1", "32")):
            spark.conf.set(k, v)
        joined = join_hot(big, small, "k", "left", task_rows=200)
        parts = [n for n in joined.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert sum(parts) == 9000 and max(parts) < 1500        # a third is 3,000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["right", "full_outer"])
def test_hot_join_refuses_to_keep_the_copied_side(spark, how):
    with pytest.raises(ValueError):
        join_hot(skewed(spark), skewed(spark).withColumnRenamed("v", "w"), "k", how)


def test_ranks_equal_a_window(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["Day", "Night", None]) if rng.random() < 0.5 else "Day", rng.randint(0, 9), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, v int, i long").repartition(7)
    got = {r.i: r["rank"] for r in R.rank_all(df, ["g"], [F.col("v").desc(), F.col("i")]).collect()}
    for g in ("Day", "Night", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in mine] == list(range(1, len(mine) + 1))
    assert R.rank_all(df.limit(0), ["g"], [F.col("i")]).count() == 0


def test_no_window_over_a_whole_part(spark):
    """Ranking every cell orders counts of tasks only: the ranked rows meet no window."""
    plan = G.hotspots_by_part(B.geo(spark, SF), 500)._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.splitlines() if "Window " in line)
    assert "__task" in window and "sum(__n" in window and "row_number" not in plan


def km(a, b):
    la, lb, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(d / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def test_nearest_of_every_center(spark):
    rng = random.Random(6)
    points = [(i, 34 + rng.gauss(0, 0.02), -118.2 + rng.gauss(0, 0.02)) for i in range(400)]
    points += [(1000 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)]        # sparse elsewhere
    points += [(2000, 10.0, 179.99), (2001, 10.0, -179.98), (2002, 89.9, 0.0), (2003, 89.9, 180.0), (2004, -90.0, 5.0), (2005, 34.0, -118.2), (2006, 34.0, -118.2)]
    centers = [("dense", 34.0, -118.2), ("edge", 34.05, -118.15), ("line", 10.0, 179.995), ("line2", 10.01, -179.999), ("pole", 90.0, 0.0),
               ("south", -89.99, 100.0), ("far", -40.0, 60.0), ("far2", 0.0, 0.0)]
    centers += [(f"r{i}", rng.uniform(-85, 85), rng.uniform(-180, 180)) for i in range(20)]
    p = spark.createDataFrame([*points, (3000, None, 1.0), (3001, float("nan"), 1.0)], "DR_NO long, LAT_d double, LON_d double").repartition(3)
    c = spark.createDataFrame([*centers, centers[0], ("none", None, 0.0), (None, 1.0, 1.0)], "center_id string, center_lat double, center_lon double")
    got = {}
    for r in G.nearest_rings(p, c, 4).collect():
        got.setdefault(r.center_id, {})[r["rank"]] = (round(r.dist_km, 6), r.DR_NO)
    assert set(got) == {x[0] for x in centers}
    for name, a, b in centers:
        want = sorted((round(km((a, b), (y, x)), 6), i) for i, y, x in points)[:4]
        mine = [got[name][k] for k in (1, 2, 3, 4)]
        assert [d for d, _ in mine] == [d for d, _ in want], name
        if len({d for d, _ in want}) == 4:
            assert mine == want, name
    assert [got["dense"][k][1] for k in (1, 2)] == [2005, 2006]


def test_nearest_of_few_points_and_none(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "center_id int, center_lat double, center_lon double")
    p = spark.createDataFrame([(7, 0.0, 1.0)], "DR_NO long, LAT_d double, LON_d double")
    assert sorted((r.center_id, r["rank"], r.DR_NO) for r in G.nearest_rings(p, c, 3, start_level=9).collect()) == [(1, 1, 7), (2, 1, 7)]
    assert G.nearest_rings(p.limit(0), c, 3, start_level=12).count() == 0 and G.nearest_rings(p, c.limit(0), 3).count() == 0


def test_nearest_rings_has_no_cross_join(spark):
    p = spark.createDataFrame([(7, 0.0, 1.0)], "DR_NO long, LAT_d double, LON_d double")
    out = G.nearest_rings(p, spark.createDataFrame([(1, 0.0, 0.9999)], "center_id int, center_lat double, center_lon double"), 1)
    assert out.count() == 1 and "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("shuffled", [False, True])
def test_crowded_places_are_not_met_whole(spark, monkeypatch, shuffled):
    """Centers in and around a crowd meet a few of its points, one at a place of very many too, and find the nearest."""
    rng = random.Random(8)
    points = [(i, 34 + rng.gauss(0, 0.0008), -118.2 + rng.gauss(0, 0.0008)) for i in range(4000)]
    points += [(9000 - i, 34.0005, -118.2005) for i in range(3000)]           # one place, lowest keys last
    points += [(10_000 + i, rng.uniform(33.9, 34.1), rng.uniform(-118.3, -118.1)) for i in range(200)]
    centers = [(i, 34 + rng.gauss(0, 0.001), -118.2 + rng.gauss(0, 0.001)) for i in range(40)]
    centers += [(100, 34.0005, -118.2005), (101, 34.0005, -118.2005), (102, 34.0, -118.19), (103, 36.0, -118.2), (104, -34.0, 61.8), (105, -0.0, 0.0), (106, 0.0, -0.0)]
    p = spark.createDataFrame(points, "DR_NO long, LAT_d double, LON_d double").repartition(3)
    c = spark.createDataFrame(centers, "center_id int, center_lat double, center_lon double")
    if shuffled:
        monkeypatch.setattr(G, "MAX_BROADCAST_ROWS", 10)
        monkeypatch.setattr(G, "TASK_CENTERS", 3)
    pairs, meet = [], G._nearest_in

    def counted(points, around, *more):
        pairs.append(points.join(around, sorted(set(points.columns) & set(around.columns))).count())
        return meet(points, around, *more)

    monkeypatch.setattr(G, "_nearest_in", counted)
    got = {}
    for r in G.nearest_rings(p, c, 4).collect():
        got.setdefault(r.center_id, {})[r["rank"]] = (round(r.dist_km, 6), r.DR_NO)
    for name, a, b in centers:
        want = sorted((round(km((a, b), (y, x)), 6), i) for i, y, x in points)[:4]
        mine = [got[name][k] for k in (1, 2, 3, 4)]
        assert [d for d, _ in mine] == [d for d, _ in want], name
        if name != 104:           # near the antipode doubles tell distances apart less finely
            assert mine == want, name
    assert [i for _, i in sorted(got[100].values(), key=lambda v: v[1])] == [6001, 6002, 6003, 6004]
    assert sum(pairs) < 1000 * len(centers)       # of 7,200 points each
