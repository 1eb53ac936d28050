"""Published tables, what they read, versions and failures; quarantine; years from metadata."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tractscope.operators import clean as C
from tractscope.operators import filters as FL
from tractscope.operators import spatial as G
from tractscope.plans import frames as B
from tractscope.plans.pipeline import run_batch_pipeline
from tractscope.plans.registry import CATALOG
from tractscope.schemas import RAW_TRACT
from tractscope.sources import files as S
from tractscope.sources import layout as L

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def many_files(spark):
    """Small shuffles are not merged, so that a table has many files."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def points(spark, n=4000):
    lat = F.lit(33.7) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 2000.0
    lon = F.lit(-118.7) + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 2000.0
    return spark.range(n).select(F.col("id").alias("DR_NO"), (F.lit(2020) + F.col("id") % 3).cast("int").alias("Occured_Year"),
                                 lat.alias("LAT"), lon.alias("LON"), F.lit("t").alias("text"))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_morton_keys_interleave(spark):
    df = spark.createDataFrame([(-90.0, -180.0), (90.0, 180.0), (90.0, -180.0), (-90.0, 180.0), (None, 1.0), (float("nan"), 1.0), (400.0, 0.0)], "a double, b double")
    got = [r[0] for r in df.select(L.morton_key("a", "b")).collect()]
    odd, even = int("10" * L.BITS, 2), int("01" * L.BITS, 2)
    assert got[:4] == [0, odd | even, even, odd] and got[4] is None and got[5] is None and got[6] is not None
    step = 180.0 / ((1 << L.BITS) - 1)
    near = spark.createDataFrame([(-90.0 + 5.5 * step, -180.0)], "a double, b double").select(L.morton_key("a", "b")).first()[0]
    assert near == int("010001", 2)


@pytest.mark.parametrize("box", [(33.8, 33.9, -118.6, -118.5), (33.0, 35.0, -118.45, -118.40), (33.75, 33.78, -120.0, -110.0), (50.0, 51.0, 0.0, 1.0)])
def test_ranges_of_either_axis_open_fewer_files(spark, scratch, many_files, box):
    df = points(spark)
    L.publish(df, f"{scratch}/t")
    whole = L.read_current(spark, f"{scratch}/t")
    assert rows_of(whole) == rows_of(df) and whole.dtypes == df.dtypes
    found = L.read_current(spark, f"{scratch}/t", box)
    assert rows_of(found) == rows_of(df.where(F.col("LAT").between(*box[:2]) & F.col("LON").between(*box[2:])))
    assert len(found.inputFiles()) <= len(whole.inputFiles()) * 0.7 and len(whole.inputFiles()) >= 40
    one = L.read_current(spark, f"{scratch}/t", box, [2021])
    assert rows_of(one) == rows_of(found.where("Occured_Year = 2021")) and len(one.inputFiles()) <= max(1, len(found.inputFiles()))


def test_radius_queries_open_fewer_files(spark, scratch, many_files):
    df = points(spark)
    L.publish(df, f"{scratch}/t")
    near = lambda t: rows_of(G.within_radius(C.valid_geo(t), 34.0, -118.45, 3.0).select("DR_NO"))
    opened = L.read_current(spark, f"{scratch}/t", G.radius_box(34.0, -118.45, 3.0))
    assert near(opened) == near(df) != [] and len(opened.inputFiles()) <= len(L.read_current(spark, f"{scratch}/t").inputFiles()) / 2


def test_unplaced_rows_stay(spark, scratch):
    odd = spark.createDataFrame([(1, 2020, None, 1.0, "a"), (2, None, float("nan"), -118.0, "b"), (3, 2020, 34.0, None, "c"), (4, 2020, 34.0, -118.0, "d")], points(spark).schema)
    L.publish(odd, f"{scratch}/t")
    assert L.read_current(spark, f"{scratch}/t").count() == 4
    assert L.manifest(spark, f"{scratch}/t").agg(F.sum("n_unplaced"), F.sum("n_rows")).first()[1] == 4
    assert [r.DR_NO for r in L.read_current(spark, f"{scratch}/t", (30.0, 40.0, -120.0, -100.0)).collect()] == [4]
    L.publish(odd.limit(0), f"{scratch}/empty")
    assert L.read_current(spark, f"{scratch}/empty").count() == 0 and L.read_current(spark, f"{scratch}/empty").columns == odd.columns


def test_a_reader_keeps_the_old_version(spark, scratch):
    root, df = f"{scratch}/t", points(spark, 600)
    L.publish(df, root)
    before = L.read_current(spark, root)
    L.publish(df.where("DR_NO < 10"), root)
    assert before.count() == 600 and L.read_current(spark, root).count() == 10
    assert L.read_current(spark, root, version=1).count() == 600 and L.versions(spark, root) == [1, 2]


def test_a_failed_write_leaves_the_table(spark, scratch):
    root, df = f"{scratch}/t", points(spark, 300)
    L.publish(df, root)
    broken = df.withColumn("text", F.when(F.col("DR_NO") == 299, F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        L.publish(broken, root)
    with pytest.raises(Exception, match="stop"):
        L.publish_years(broken, root)
    assert L.versions(spark, root) == [1] and rows_of(L.read_current(spark, root)) == rows_of(df)


def test_of_two_writers_one_fails(spark, scratch):
    root, df = f"{scratch}/t", points(spark, 100)
    first = L.publish(df, root)
    assert L.publish(df.limit(5), root, expected=first) == 2
    with pytest.raises(RuntimeError):
        L.publish(df.limit(7), root, expected=first)
    assert L.read_current(spark, root).count() == 5


def test_readers_during_rewrites_see_whole_versions(spark, scratch):
    root, df = f"{scratch}/t", points(spark, 200)
    L.publish(df, root)
    seen: set[int] = set()
    stop = threading.Event()

    def read() -> None:
        while not stop.is_set():
            seen.add(L.read_current(spark, root).count())

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for n in (150, 100, 50):
            L.publish(df.where(F.col("DR_NO") < n), root)
    finally:
        stop.set()
        reader.join()
    assert seen <= {200, 150, 100, 50}


def test_only_touched_years_are_rewritten(spark, scratch):
    root, df = f"{scratch}/t", points(spark, 900)
    L.publish(df, root)
    old = {r.file: r.year for r in L.manifest(spark, root).collect()}
    new = df.where("Occured_Year = 2021").withColumn("text", F.lit("new"))
    fresh = new.limit(3).withColumns({"Occured_Year": F.lit(None).cast("int"), "text": F.lit("null year")})
    assert L.publish_years(new.unionByName(fresh), root) == 2
    want = df.where("Occured_Year <> 2021").unionByName(new)
    got = L.read_current(spark, root)
    assert rows_of(got.where("text <> 'null year'")) == rows_of(want) and got.where("text = 'null year'").count() == 3
    now = {r.file for r in L.manifest(spark, root).collect()}
    assert {f for f, y in old.items() if y != 2021} <= now and not {f for f, y in old.items() if y == 2021} & now
    assert L.published_years(spark, root) == [2022, 2021, 2020]
    assert L.vacuum(spark, root) == 0               # the first version's files of other years are still listed
    L.publish(df.limit(1), root)
    assert L.vacuum(spark, root) == 2 and L.versions(spark, root) == [3] and L.read_current(spark, root).count() == 1
    with pytest.raises(ValueError):
        L.publish_years(df.drop("text"), root)


def test_nothing_published(spark, scratch):
    for read in (L.read_current, L.manifest, L.published_years):
        with pytest.raises(FileNotFoundError):
            read(spark, f"{scratch}/none")
    assert L.publish_years(points(spark, 5), f"{scratch}/none") == 1


# ---------------------------------------------------------------- quarantine


def test_the_pipeline_counts_and_keeps_what_does_not_parse(spark, scratch):
    inc = B.raw_incidents(spark, SF)
    text = inc.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in inc.columns])
    bad = text.limit(2).withColumns({"DR_NO": F.when(F.col("DR_NO") > 0, F.concat(F.lit("9"), F.col("DR_NO"))), "Vict Age": F.lit("forty"), "LAT": F.lit("n/a")})
    text.unionByName(bad).write.option("header", True).csv(f"{scratch}/inc")
    tr = B.raw_tracts(spark, SF).drop("med_hh_income_text")
    tr = tr.select(*[F.col(c).cast("string").alias(c) for c in tr.columns]).unionByName(
        spark.createDataFrame([("77", "SPA 4 - Metro", "$1,2x", "Low Income")], "tract string, spa string, med_hh_income string, ami_category string"))
    tr.write.option("header", True).csv(f"{scratch}/tr")
    out = run_batch_pipeline(spark, f"{scratch}/inc", f"{scratch}/tr", f"{scratch}/out")
    report = {(r.table_name, r.metric): r.value for r in spark.read.parquet(f"{scratch}/out/read_report").collect()}
    assert report["incidents", "n_rows"] == inc.count() + 2 and report["incidents", "n_rejected_rows"] == 2
    assert report["incidents", "rejected: Vict Age"] == 2 == report["incidents", "rejected: LAT"] and report["incidents", "rejected: LON"] == 0
    assert report["tracts", "rejected: med_hh_income"] == 1
    lost = spark.read.parquet(f"{scratch}/out/incidents_rejected")
    assert sorted((r.column_name, r.text) for r in lost.collect()) == [("LAT", "n/a")] * 2 + [("Vict Age", "forty")] * 2
    assert {r.row["Vict Age"] for r in lost.collect()} == {None} and {r.DR_NO for r in lost.collect()} == {r.row["DR_NO"] for r in lost.collect()}
    assert [(r.tract, r.text) for r in spark.read.parquet(f"{scratch}/out/tracts_rejected").collect()] == [(77, "$1,2x")]
    assert spark.read.parquet(out).count() == B.clean(spark, SF).count()


def test_checked_reading_equals_plain_reading(spark, scratch):
    spark.createDataFrame([("1", " A ", "$61,994 ", "x"), ("2.0", "B", " ", "y"), ("z", None, None, None)],
                          "tract string, spa string, med_hh_income string, ami_category string").write.option("header", True).csv(f"{scratch}/t")
    checked = S.read_checked(spark, f"{scratch}/t", RAW_TRACT)
    assert rows_of(checked.drop(S.REJECTS)) == rows_of(S.read_tracts_csv(spark, f"{scratch}/t"))
    assert sorted(str(r[0]) for r in checked.select(F.expr("transform(_rejects, r -> r.text)")).collect()) == ["['z']", "[]", "[]"]


def test_a_partitioned_write_evaluates_its_input_once(spark, scratch):
    counted = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            counted.add(b.num_rows)
            yield b

    df = points(spark, 500).mapInArrow(count, points(spark).schema)
    S.write_table(df, f"{scratch}/t", ["Occured_Year"], ["LAT"])
    assert counted.value == 500
    L.publish(points(spark, 500).mapInArrow(count, points(spark).schema), f"{scratch}/p")
    assert counted.value == 1000
    assert spark.read.parquet(f"{scratch}/t").count() == 500


# ---------------------------------------------------------------- years from metadata


def test_years_of_folders(spark, scratch):
    df = points(spark, 90).withColumn("Occured_Year", F.when(F.col("DR_NO") % 9 > 0, F.col("Occured_Year")))
    S.write_table(df, f"{scratch}/t", ["Occured_Year"], ["LAT"])
    years = [int(y) for y in S.partition_values(spark, f"{scratch}/t", "Occured_Year")]
    assert years == [2020, 2021, 2022]
    stored = S.read_table(spark, f"{scratch}/t")
    assert rows_of(FL.filter_years_known(stored, years, 2).select(*df.columns)) == rows_of(FL.filter_latest_years(stored, 2).select(*df.columns))
    assert FL.filter_years_known(stored, [], 2).count() == 0
    spark.createDataFrame([("a b/c", 1)], "k string, v int").write.partitionBy("k").parquet(f"{scratch}/odd")
    assert S.partition_values(spark, f"{scratch}/odd", "k") == ["a b/c"]


@pytest.mark.parametrize("name", sorted(n for n in CATALOG if n.endswith("_stored")))
def test_the_default_view_is_one_scan(spark, name):
    plan = CATALOG[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "orders.parquet" not in plan
    assert "PartitionFilters: [Occured_Year" in plan and "Join" not in plan


def test_pointer_files_name_their_manifest(spark, scratch):
    L.publish(points(spark, 10), f"{scratch}/t")
    with open(f"{scratch}/t/pointers/000000001.json") as fh:
        entry = json.load(fh)
    assert entry["columns"] == ["Occured_Year", "LAT", "LON"] and spark.read.parquet(entry["manifest"]).count() >= 1
