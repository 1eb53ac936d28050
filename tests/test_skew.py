"""One key holding a third of all rows: results stay exact, and the plans
combine on the map side before shuffling."""

from pyspark.sql import functions as F

from tractscope.operators import rank as R
from tractscope.operators import spatial as G
from tractscope.operators import summary as A
from tractscope.operators.joins import join_small


def _skewed(spark, n=30000):
    # a third of the rows in cell (0, 0) / group "hot"
    df = spark.range(n).select(
        F.col("id").alias("DR_NO"),
        F.when(F.col("id") % 3 == 0, F.lit(34.0)).otherwise(33.7 + (F.col("id") % 97) / 500.0).alias("LAT_d"),
        F.when(F.col("id") % 3 == 0, F.lit(-118.3)).otherwise(-118.6 + (F.col("id") % 89) / 500.0).alias("LON_d"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("g"),
        (F.col("id") % 7).cast("string").alias("spa"),
    )
    return df


def test_hotspots_exact_under_skew(spark):
    df = _skewed(spark)
    pdf = df.toPandas()
    pdf["lat_i"] = (pdf.LAT_d * 500).apply(lambda v: int(__import__("math").floor(v)))
    pdf["lon_i"] = (pdf.LON_d * 500).apply(lambda v: int(__import__("math").floor(v)))
    want = pdf.groupby(["lat_i", "lon_i"]).size().reset_index(name="count")
    want = want.sort_values(["count", "lat_i", "lon_i"], ascending=[False, True, True]).head(25)
    got = G.hotspots(df, 500, 25).select("lat_i", "lon_i", "count").toPandas()
    assert got.values.tolist() == want.values.tolist()
    plan = G.hotspots(df, 500, 25)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_top_per_group_exact_under_skew(spark):
    df = _skewed(spark)
    counts = A.count_by(df, ["g", "spa"])
    got = R.top_per_group(counts, ["g"], [F.col("count").desc(), F.col("spa")], 2).toPandas()
    pdf = counts.toPandas().sort_values(["g", "count", "spa"], ascending=[True, False, True])
    want = pdf.groupby("g").head(2)
    key = ["g", "spa", "count"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, want[key].values.tolist()))
    best = R.top_one_per_group(counts, ["g"], "count", "spa").toPandas()
    want1 = pdf.groupby("g").head(1)
    assert sorted(map(tuple, best[key].values.tolist())) == sorted(map(tuple, want1[key].values.tolist()))


def test_salted_join_exact_under_hot_key(spark):
    big = _skewed(spark).select("DR_NO", "g")
    small = spark.createDataFrame([("hot", 1.0), ("hot", 2.0), ("3", 5.0)], "g string, v double")
    a = join_small(big, small, "g", "left").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    b = join_small(big, small, "g", "left", max_broadcast_rows=0, salt_buckets=16) \
        .groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    hot = {r.g: r.n for r in b.collect()}["hot"]
    assert hot == 2 * 10000


def test_first_k_by_exact_and_bounded(spark):
    df = spark.range(20000).select(
        F.col("id").alias("k"),
        F.when(F.col("id") < 300, F.col("id")).otherwise(F.lit(10 ** 9) + F.col("id")).alias("v"),
        (F.col("id") % 7 / 3.0).alias("d"),
    )
    for col, k, tb in (("v", 500, []), ("v", 50, []), ("d", 40, ["k"]), ("k", 25000, [])):
        got = [tuple(r) for r in R.first_k_by(df, col, k, tb).collect()]
        pdf = df.toPandas().sort_values([col, *tb]).head(k)
        assert got == [tuple(r) for r in pdf.itertuples(index=False)]
    nulls = spark.range(30).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    for k in (5, 15, 20):  # one null order at every size
        assert [r.v for r in R.first_k_by(nulls, "v", k).collect()] == ([*range(0, 30, 2)] + [None] * 5)[:k]
