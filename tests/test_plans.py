"""Physical-plan checks: pushdown, broadcast, pre-shuffle limits."""

from tractscope.operators import clean as C
from tractscope.operators import spatial as G
from tractscope.plans import frames as B
from tractscope.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def _stored(spark, scratch):
    path = f"{scratch}/clean.parquet"
    B.clean(spark, SF).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_box_and_radius_reach_the_scan(spark, scratch):
    stored = _stored(spark, scratch)
    box = G.within_box(C.valid_geo(stored), 34.0, 34.08, -118.3, -118.2)
    plan = _plan(box)
    assert "PushedFilters" in plan and "GreaterThanOrEqual(LAT,34.0)" in plan
    near = G.within_radius(C.valid_geo(stored), 34.0522, -118.2437, 2.0)
    plan = _plan(near)
    assert "GreaterThanOrEqual(LAT,34.03" in plan and "LessThanOrEqual(LON,-118.22" in plan


def test_filters_prune_columns(spark, scratch):
    stored = _stored(spark, scratch)
    plan = _plan(G.hotspots(C.valid_geo(stored), 500, 10))
    assert "ReadSchema: struct<LAT:double,LON:double>" in plan


def test_region_join_is_broadcast(spark):
    plan = _plan(B.enriched(spark, SF).select("DR_NO", "med_hh_income"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_unused_income_join_is_removed(spark):
    plan = _plan(B.enriched(spark, SF).select("DR_NO", "spa"))
    assert "Join" not in plan


def test_day_night_limits_before_shuffle(spark):
    df = CATALOG["hotspots_day_night"][0](spark, SF)
    plan = _plan(df)
    assert "WindowGroupLimit" in plan
