"""Invariants over the derived test tables (sf0.001)."""

from pyspark.sql import functions as F

from tractscope.operators import spatial as G
from tractscope.operators import summary as A
from tractscope.plans import frames as B

SF = "/root/testdata/sf0.001"


def test_region_join_keeps_rows(spark):
    assert B.enriched(spark, SF).count() == B.regioned(spark, SF).count()


def test_fanout_multiplier(spark):
    clean = {r.spa: r["count"] for r in A.count_by(B.regioned(spark, SF), "spa").collect()}
    fan = {r.spa: r["count"] for r in A.count_by(B.enriched_fanout(spark, SF), "spa").collect()}
    t = B.tracts(spark, SF)
    triples = {r.spa: r.n for r in t.select("spa", "med_hh_income", "ami_category").distinct()
               .groupBy("spa").agg(F.count(F.lit(1)).alias("n")).collect()}
    for spa, n in clean.items():
        assert fan[spa] == n * max(1, triples.get(spa, 0))


def test_counts_sum_to_total(spark):
    e = B.enriched(spark, SF)
    total = e.count()
    assert A.count_by(e, "Occured_Month").agg(F.sum("count")).first()[0] == total
    shares = A.share_by(e, "Weapon_Used").agg(F.sum("pct")).first()[0]
    assert abs(shares - 100.0) < 1e-9


def test_grid_contains_point(spark):
    g = G.add_grid(B.geo(spark, SF), 500)
    bad = g.filter((F.col("lat_grid") > F.col("LAT_d")) | (F.col("LAT_d") >= F.col("lat_grid") + 1.0 / 500 + 1e-12)
                   | (F.col("lon_grid") > F.col("LON_d"))).count()
    assert bad == 0


def test_day_plus_night(spark):
    geo = B.geo(spark, SF)
    parts = G.hotspots_by_part(geo, 500, 10 ** 6)
    assert parts.agg(F.sum("count")).first()[0] == geo.count()


def test_weighted_fanout_equals_literal_fanout(spark):
    from tractscope.operators.enrich import FANOUT_WEIGHT as W
    lit_ = B.enriched_fanout(spark, SF)
    wtd = B.enriched_weighted(spark, SF)
    assert wtd.count() == B.regioned(spark, SF).count()
    a = {tuple(r) for r in A.count_by(lit_, ["spa", "Occured_Year"]).collect()}
    b = {tuple(r) for r in A.count_by(wtd, ["spa", "Occured_Year"], weight=W).collect()}
    assert a == b
    pa = {r.spa: (r.crime_count, round(r.avg_income, 6), r.avg_victim_age, r.weapon_rate)
          for r in A.region_profile(lit_).collect()}
    pb = {r.spa: (r.crime_count, round(r.avg_income, 6), r.avg_victim_age, r.weapon_rate)
          for r in A.region_profile(wtd, weight=W).collect()}
    assert pa == pb


def test_fanout_salted_fallback_equals_broadcast(spark):
    from tractscope.operators import enrich as J

    inc, tr = B.regioned(spark, SF), B.tracts(spark, SF)
    cols = ["DR_NO", "spa", "med_hh_income", "ami_category"]
    a = J.enrich_fanout(inc, tr).select(*cols)
    # no broadcast hint: the salted shuffle join (keys spa + salt)
    b = J.enrich_fanout(inc, tr, salt_buckets=8, max_broadcast_rows=0).select(*cols)
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "__salt" in plan
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_fused_hotspots_equal_j2_path(spark):
    from tractscope.operators import clean as C
    from tractscope.operators import enrich as J
    from tractscope.operators import rank as R

    e = B.enriched(spark, SF)
    fused = G.hotspots_with_region(e, 500, None)
    cells = G.hotspots(C.valid_geo(e), 500, None)
    dominant = R.top_one_per_group(A.cell_region_counts(e, 500), ["lat_i", "lon_i"], "n", "spa")
    joined = J.label_cells(cells, dominant.select("lat_i", "lon_i", "spa"))
    cols = ["lat_i", "lon_i", "count", "spa"]
    assert sorted(map(tuple, fused.select(*cols).collect())) == sorted(map(tuple, joined.select(*cols).collect()))
