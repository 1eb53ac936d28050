"""Hand-made edge rows (FIXTURES.md section 3)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tractscope.functions import columns as X
from tractscope.operators import clean as C
from tractscope.operators import enrich as J
from tractscope.operators import filters as FL
from tractscope.operators import model as M
from tractscope.operators import spatial as G
from tractscope.operators import summary as A


def test_date_text(spark):
    df = spark.createDataFrame([("01/02/2020 12:00:00 AM",), ("01/02/2020 12:00:00 PM",), ("junk",), (None,)], "s string")
    got = [r[0] for r in df.select(X.parse_date_text("s")).collect()]
    assert got == [dt.date(2020, 1, 2), dt.date(2020, 1, 2), None, None]


def test_hhmm(spark):
    df = spark.createDataFrame([(0,), (45,), (1310,), (2359,), (None,)], "t int")
    assert [r[0] for r in df.select(X.hour_from_hhmm("t")).collect()] == [0, 0, 13, 23, None]


def test_age_filter(spark):
    df = spark.createDataFrame([(-1,), (0,), (1,), (None,)], "Vict_Age int")
    assert [r[0] for r in C.drop_invalid_age(df).collect()] == [1]


def test_zero_coords(spark):
    df = spark.createDataFrame([(0.0, 0.0), (34.0, 0.0), (None, -118.0), (34.0, -118.0)], "LAT double, LON double")
    assert [tuple(r) for r in C.drop_zero_coords(df).collect()] == [(34.0, -118.0)]


def test_area_mapping(spark):
    df = spark.createDataFrame([("Northeast",), ("Harbor",), (None,)], "AREA_NAME string")
    assert [r.spa for r in C.map_area_to_region(df).collect()] == ["SPA 4 - Metro", "Other", "Other"]


def test_day_part(spark):
    df = spark.createDataFrame([(5,), (6,), (17,), (18,), (None,)], "Hour int")
    assert [r.day_part for r in C.add_day_part(df).collect()] == ["Night", "Day", "Day", "Night", "Night"]


def test_money(spark):
    df = spark.createDataFrame([("$1,234",), ("61994.5",), ("n/a",), (None,)], "m string")
    assert [r[0] for r in df.select(X.parse_money("m")).collect()] == [1234.0, 61994.5, None, None]


def test_box_edges_inclusive(spark):
    pts = [(34.0, -118.3), (34.08, -118.2), (34.0, -118.2), (34.08, -118.3), (34.081, -118.25)]
    df = spark.createDataFrame(pts, "LAT_d double, LON_d double")
    assert G.within_box(df, 34.0, 34.08, -118.3, -118.2).count() == 4


def test_distance_at_center(spark):
    df = spark.createDataFrame([(34.0522, -118.2437)], "LAT_d double, LON_d double")
    assert G.add_distance(df, 34.0522, -118.2437).first().dist_km == 0.0


def test_radius_box_contains_circle():
    for lat0 in (0.0, 34.05, 70.0, -60.0):
        la_min, la_max, lo_min, lo_max = G.radius_box(lat0, 10.0, 5.0)
        # a point 5 km due north/east must be inside the box
        assert la_max - lat0 >= math.degrees(5.0 / 6371.0)
        assert lo_max - 10.0 >= math.degrees(5.0 / 6371.0) / math.cos(math.radians(lat0))


def test_topk_tie_lowest_key(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "k string")
    got = [tuple(r) for r in A.top_counts(df, "k", 2).collect()]
    assert got == [("c", 2), ("a", 1)]


def test_top_one_tie_lowest_label(spark):
    from tractscope.operators.rank import top_one_per_group
    df = spark.createDataFrame([(1, "y", 3), (1, "x", 3), (1, "z", 1), (2, None, 5), (2, "q", 5)],
                               "g int, spa string, n long")
    got = sorted(tuple(r) for r in top_one_per_group(df, ["g"], "n", "spa").collect())
    assert got == [(1, "x", 3), (2, "q", 5)]


def test_column_collision(spark):
    df = spark.createDataFrame([(1, 2)], "`a b` int, a_b int")
    with pytest.raises(ValueError):
        C.standardize_columns(df)


def test_empty_filter_lists(spark):
    df = spark.createDataFrame([("x", 2000, 1), ("y", 2001, None)], "spa string, Occured_Year int, Occured_Month int")
    assert FL.apply_filters(df).count() == 2


def test_region_without_tract(spark):
    inc = spark.createDataFrame([(1, "Other"), (2, "SPA 4 - Metro")], "DR_NO long, spa string")
    tr = spark.createDataFrame([("SPA 4 - Metro", 50000.0, "Low Income")],
                               "spa string, med_hh_income double, ami_category string")
    got = {r.DR_NO: r.med_hh_income for r in J.enrich_region(inc, tr).collect()}
    assert got == {1: None, 2: 50000.0}


def test_constant_column_correlation(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 4.0)], "a double, b double")
    rows = {(r.feature_a, r.feature_b): r.r for r in M.correlation_long(df, ["a", "b"]).collect()}
    assert math.isnan(rows[("a", "b")]) and math.isnan(rows[("a", "a")])
    assert rows[("b", "b")] == 1.0


def test_impute_fills_all_nulls(spark):
    df = spark.createDataFrame([(1, "Low Income", 10.0), (2, "Low Income", 20.0), (3, "Other", None), (4, None, None)],
                               "tract long, ami_category string, med_hh_income double")
    got = {r.tract: r.med_hh_income for r in C.impute_income(df).collect()}
    assert got == {1: 10.0, 2: 20.0, 3: 15.0, 4: 15.0}


def test_fanout_salted_path_matches_broadcast(spark):
    from tractscope.operators.joins import join_small
    big = spark.range(200).select(F.col("id").alias("DR_NO"), (F.col("id") % 3).cast("string").alias("spa"))
    small = spark.createDataFrame([("0", 1.0), ("0", 2.0), ("1", 3.0)], "spa string, v double")
    a = sorted(tuple(r) for r in join_small(big, small, "spa", "left").collect())
    b = sorted(tuple(r) for r in join_small(big, small, "spa", "left", max_broadcast_rows=0, salt_buckets=7).collect())
    assert a == b and len(a) == 67 * 2 + 67 + 66


def test_empty_input(spark):
    from tractscope.operators import rank as R
    from tractscope.plans import frames as B

    empty = B.enriched(spark, "/root/testdata/sf0.001").limit(0)
    geo = C.valid_geo(empty)
    assert G.hotspots(geo, 500, 10).count() == 0
    assert G.hexbin(geo).count() == 0
    assert G.hotspots_with_region(empty, 500, 10).count() == 0
    assert A.top_counts(empty, "Crm_Cd_Desc", 5).count() == 0
    assert A.share_by(empty, "Weapon_Used").count() == 0
    assert A.region_profile(empty).count() == 0
    assert R.first_k_by(geo.select("DR_NO"), "DR_NO", 5000).count() == 0
    assert G.nearest(geo, 34.0522, -118.2437, 2.0, 10).count() == 0
    assert FL.filter_latest_years(empty).count() == 0
    assert M.correlation_long(A.region_profile(empty)).count() == 16
