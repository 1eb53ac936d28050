"""Inputs the derived tables never hold: odd texts, large counts, edges of the globe, hot and null labels."""

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from tractscope.operators import clean as C
from tractscope.operators import enrich as J
from tractscope.operators import model as M
from tractscope.operators import profile as P
from tractscope.operators import spatial as G
from tractscope.operators.joins import join_small
from tractscope.schemas import RAW_INCIDENT, RAW_TRACT
from tractscope.sources import files as S


def test_money_and_decimal_integers_survive_reading(spark, scratch):
    spark.createDataFrame([("1", " A ", "$61,994 ", "Low Income"), ("2", "B", "$90,000", "x"), ("3", "C", "n/a", "x"), ("4", "C", "", "x")],
                          "tract string, spa string, med_hh_income string, ami_category string") \
        .write.option("header", True).csv(f"{scratch}/t")
    tracts = S.read_tracts_csv(spark, f"{scratch}/t")
    assert {r.tract: r.med_hh_income for r in tracts.collect()} == {1: 61994.0, 2: 90000.0, 3: None, 4: None}
    assert {r.tract: r.med_hh_income for r in C.clean_tracts(tracts).collect()}["2"] == 90000.0
    raw = spark.read.option("header", True).csv(f"{scratch}/t")
    assert {r.column_name: r.unparsed for r in S.unparsed_counts(raw, RAW_TRACT).collect()}["med_hh_income"] == 1
    spark.createDataFrame([("7", "1310.0", "400.0", "12.5")], "DR_NO string, `TIME OCC` string, `Weapon Used Cd` string, `Vict Age` string") \
        .write.option("header", True).csv(f"{scratch}/i")
    row = S.read_incidents_csv(spark, f"{scratch}/i").first()
    assert (row["TIME OCC"], row["Weapon Used Cd"], row["Vict Age"]) == (1310, 400, None)
    lost = S.unparsed_counts(spark.read.option("header", True).csv(f"{scratch}/i"), RAW_INCIDENT).collect()
    assert {r.column_name for r in lost if r.unparsed} == {"Vict Age"}


def test_r2_of_large_counts_equals_mllib(spark):
    df = spark.range(50).select((F.lit(10 ** 9) + F.col("id") % 7).cast("double").alias("crime_count"),
                                (F.lit(10 ** 9) + F.col("id") % 7 + F.col("id") % 2).cast("double").alias("prediction"))
    want = RegressionEvaluator(labelCol="crime_count", metricName="r2").evaluate(df)
    assert M.regression_metrics(df).first().r2 == pytest.approx(want, abs=1e-6)


def test_null_profile_of_an_empty_table(spark):
    rows = P.null_profile(spark.createDataFrame([], "a int, b string")).collect()
    assert [(r.null_count, r.null_pct) for r in rows] == [(0, None), (0, None)]


def test_radius_across_the_date_line(spark):
    df = spark.createDataFrame([(1, 0.0, -179.997), (2, 0.0, 179.993), (3, 0.0, 170.0)], "DR_NO long, LAT_d double, LON_d double")
    assert {r.DR_NO for r in G.within_radius(df, 0.0, 179.999, 5.0).collect()} == {1, 2}


@pytest.mark.parametrize("step", [1, 100, 7919])
def test_sample_of_strided_keys(spark, step):
    df = spark.range(20000).select((F.col("id") * step).alias("k"))
    assert 0.18 < G.stable_sample(df, "k", 0.2, 42).count() / 20000 < 0.22
    assert 0 < G.stable_sample(df, "k", 0.004, 42).count() < 200
    few = [r.k for r in G.stable_sample(df, "k", 1.0, 42, n=100).collect()]
    assert len(few) == 100 and max(few) > 15000 * step  # no prefix
    assert G.stable_sample(spark.createDataFrame([(2 * 10 ** 15,)], "k long"), "k", 1.0, 42).count() == 1


@pytest.mark.parametrize("how", ["right", "full", "full_outer", "outer"])
def test_salted_join_refuses_replicated_outer(spark, how):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(ValueError):
        join_small(df, df.withColumnRenamed("v", "w"), "k", how, max_broadcast_rows=0, salt_buckets=4)


def test_labels_outside_the_mapping_join(spark):
    inc = spark.createDataFrame([(1, "SPA 1 - Antelope"), (2, None)], "DR_NO long, spa string")
    tr = spark.createDataFrame([("SPA 1 - Antelope", 70000.0, "x"), (None, 1.0, "y")], "spa string, med_hh_income double, ami_category string")
    for join in (J.enrich_region, J.enrich_fanout):
        assert {r.DR_NO: r.med_hh_income for r in join(inc, tr).collect()} == {1: 70000.0, 2: None}


def test_null_regions_count_in_cells(spark):
    df = spark.createDataFrame([(34.0001, -118.2, None), (34.0001, -118.2, "b"), (34.0001, -118.2, None), (34.0001, -118.3, None)],
                               "LAT double, LON double, spa string")
    got = {(r["count"], r.spa) for r in G.hotspots_with_region(df, 500).collect()}
    assert got == {(3, "b"), (1, None)}
    plain = G.hotspots(C.valid_geo(df), 500)
    assert sorted(r["count"] for r in plain.collect()) == [1, 3]


def test_each_remaining_k_binds_on_more_cells_than_k(spark):
    df = spark.range(3000).select((F.lit(33.6) + F.col("id") * 0.0003).alias("LAT_d"), F.lit(-118.0).alias("LON_d"),
                                  F.when(F.col("id") % 2 == 0, "Day").otherwise("Night").alias("day_part"))
    every = G.hotspots(df, 1000).count()
    assert every > 100 and G.hotspots(df, 1000, 100).count() == 100
    assert G.hotspots_by_part(df, 1000).count() > 200 and G.hotspots_by_part(df, 1000, 100).count() == 200


def test_partitioned_files_are_few_and_narrow(spark, scratch):
    df = spark.range(20000, numPartitions=16).select((F.col("id") % 7 + 2000).cast("int").alias("y"), ((F.col("id") * 7919) % 1000 / 10.0).alias("lat"))
    S.write_table(df, f"{scratch}/t", ["y"], ["lat"])
    files = spark.read.parquet(f"{scratch}/t").select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 7 + 16
    assert spark.read.parquet(f"{scratch}/t").count() == 20000


def test_limits_of_points_and_cells_bind(spark):
    from tractscope.plans import frames as B

    geo = B.geo(spark, "/root/testdata/sf0.01")
    cells, points = G.hotspots(geo, 200), G.map_points(geo)
    few_cells, few_points = G.hotspots(geo, 200, 1000), G.map_points(geo, 20)
    assert few_cells.count() == 1000 < cells.count() and few_cells.exceptAll(cells).count() == 0
    assert few_points.count() == 20 < points.count() and few_points.exceptAll(points).count() == 0
