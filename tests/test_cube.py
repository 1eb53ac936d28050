"""The stored count cube: levels, choices, nulls, merging, and what it reads."""

import random

import pytest
from pyspark.sql import functions as F

from tractscope.operators import cube as Q
from tractscope.operators import filters as FL
from tractscope.operators import summary as A
from tractscope.plans import frames as B
from tractscope.plans.registry import CATALOG

SF = "/root/testdata/sf0.001"
COLUMNS = ("spa string, Occured_Year int, Occured_Month int, Hour int, Crm_Cd_Desc string, Vict_Descent string, AREA_NAME string, "
           "Premis_Desc string, Weapon_Desc string, Weapon_Used_Cd int, Vict_Age int, med_hh_income double, fan_w long, "
           "fan_income_sum double, fan_income_n long, level string, n int")


def frame(spark, n=400, seed=1):
    rng = random.Random(seed)
    some = lambda *v: rng.choice((*v, None))
    rows = []
    for _ in range(n):
        code = some(1, 2, 3)
        rows.append((some("A", "B", "all"), some(2020, 2021, 2022), some(1, 2), some(0, 23), some("x", "y", ""), some("H"), some("N"), some("p", "q"),
                     some("w"), code, some(1, 20, 35), some(10.0, 20.5), rng.randint(1, 9), some(10.0, 99.0), rng.randint(0, 5), "clash", 1))
    return spark.createDataFrame(rows, COLUMNS).repartition(4)


@pytest.fixture(scope="module")
def df(spark):
    return frame(spark)


@pytest.fixture(scope="module")
def cube(spark, df, tmp_path_factory):
    return Q.store(df, str(tmp_path_factory.mktemp("cube")), keep_base=True)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(n for n in CATALOG if n.startswith("cube_") and not n.endswith("_fanout")))
def test_reports_read_one_level_and_no_incident(spark, name):
    cube = B.stored_cube(spark, SF)
    files = CATALOG[name][0](spark, SF).inputFiles()
    root = cube.table.inputFiles()[0].partition("/levels/")[0]
    assert files and all(f.startswith(root) for f in files)
    plan = CATALOG[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "orders.parquet" not in plan and "PartitionFilters: [isnotnull(level" in plan


@pytest.mark.parametrize("choices,fanout", [
    ({}, True), ({"years": [2021]}, False), ({"regions": ["A", "all"], "months": [2]}, True),
    ({"regions": ["B"], "years": [2020, 2022], "months": [1, 2]}, False), ({"regions": ["none"]}, False), ({"Crm_Cd_Desc": ["x", ""]}, True)])
def test_reports_equal_those_of_the_incidents(df, cube, choices, fanout):
    plain = {k: v for k, v in choices.items() if k in ("regions", "years", "months")}
    seen = FL.apply_filters(df, **plain)
    if "Crm_Cd_Desc" in choices:
        seen = seen.where(F.col("Crm_Cd_Desc").isin(*choices["Crm_Cd_Desc"]))
    w = "fan_w" if fanout else None
    if "Crm_Cd_Desc" not in choices:
        armed = seen.withColumn("Has_Weapon", F.when(F.col("Weapon_Used_Cd").isNotNull(), "Yes").otherwise("No"))
        for key in ("Hour", "Weapon_Desc", "Has_Weapon", "spa"):
            assert rows_of(Q.count_by(cube, key, fanout=fanout, **choices)) == rows_of(A.count_by(armed, key, weight=w)), key
        assert rows_of(Q.share_by(cube, "Has_Weapon", fanout=fanout, **choices)) == rows_of(A.share_by(armed, "Has_Weapon", w))
        assert rows_of(Q.pivot_counts(cube, "spa", "Has_Weapon", ["No", "Yes"], fanout, **choices)) == rows_of(
            A.pivot_counts(armed, "spa", "Has_Weapon", ["No", "Yes"], w))
    assert rows_of(Q.top_counts(cube, ["spa", "Crm_Cd_Desc"], 3, fanout, **choices)) == rows_of(A.top_counts(seen, ["spa", "Crm_Cd_Desc"], 3, w))
    assert rows_of(Q.mean_age_by(cube, "Crm_Cd_Desc", fanout=fanout, **choices)) == rows_of(A.mean_by(seen, "Crm_Cd_Desc", "Vict_Age", weight=w))
    near = lambda df: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows_of(df)]
    for ours, theirs in ((Q.region_profile, A.region_profile), (Q.region_month_panel, A.region_month_panel), (Q.income_vs_count, A.income_vs_count)):
        assert near(ours(cube, fanout, **choices)) == near(theirs(seen, weight=w))
    assert Q.filtered_count(cube, **choices).first()[0] == seen.count()


def test_the_coarsest_fitting_level_answers(spark, cube):
    assert cube.fitting([]) == () and cube.fitting(["Crm_Cd_Desc"]) == ("Crm_Cd_Desc",)
    assert cube.fitting(["Crm_Cd_Desc", "spa"]) == ("spa", "Crm_Cd_Desc")
    assert set(cube.fitting(["Hour", "Occured_Month"])) == {*Q.CHOICES, "Hour"}
    assert cube.fitting(["Hour", "Crm_Cd_Desc"]) is None
    with pytest.raises(LookupError):
        Q.CountCube(cube.table, cube.sizes).rows(["Hour", "Crm_Cd_Desc"])
    with pytest.raises(ValueError):
        cube.rows(["LAT"])
    sizes = {tuple(r["level"].split("+")) if r["level"] != "all" else (): r["count"] for r in cube.table.groupBy("level").count().collect()}
    assert sizes == dict(cube.sizes) and len(sizes) == len({*Q.FINE_LEVELS, *Q.COARSE_LEVELS})


def test_without_a_level_the_incidents_answer(df, cube):
    assert rows_of(Q.count_by(cube, ["Hour", "Crm_Cd_Desc"], years=[2021])) == rows_of(
        A.count_by(df.where("Occured_Year = 2021"), ["Hour", "Crm_Cd_Desc"]))


def test_merged_cubes_equal_one_of_all_rows(spark, scratch):
    a, b = frame(spark, 200, 1), frame(spark, 150, 2)
    few = Q.FINE_LEVELS[:2], (Q.CHOICES, (), ("spa",), ("Crm_Cd_Desc",))
    merged = Q.merge([Q.store(a, f"{scratch}/a", *few), Q.store(b, f"{scratch}/b", *few)], f"{scratch}/ab")
    whole = Q.store(a.unionByName(b), f"{scratch}/whole", *few)
    cols = ["level", *Q.DIMS, *Q.MEASURES]
    assert rows_of(merged.table.select(*cols)) == rows_of(whole.table.select(*cols)) and dict(merged.sizes) == dict(whole.sizes)
    with pytest.raises(ValueError):
        Q.merge([whole, Q.store(a, f"{scratch}/few", Q.FINE_LEVELS[:1], ())], f"{scratch}/c")


def test_plain_frames_and_latest_years(spark, scratch):
    df = frame(spark).drop("fan_w", "fan_income_sum", "fan_income_n")
    cube = Q.store(df, f"{scratch}/cube")
    assert cube.latest_years(2) == [2022, 2021] and cube.defaults(2) == {"years": [2022, 2021], "months": [1, 2]}
    assert rows_of(Q.count_by(cube, "spa", fanout=True)) == rows_of(Q.count_by(cube, "spa"))


def test_cube_of_nothing(spark, scratch):
    cube = Q.store(frame(spark, 0), f"{scratch}/cube")
    assert Q.filtered_count(cube).first()[0] == 0 and Q.count_by(cube, "Hour").count() == 0 and cube.latest_years() == []
    assert Q.region_profile(cube, years=[2020]).count() == 0
