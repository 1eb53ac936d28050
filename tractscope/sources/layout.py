"""Published tables: a space-filling layout, a manifest of files, versions.

``publish`` writes a table as a new version and then names it the current one:

* rows are range partitioned by year and by the Morton key of their
  coordinates (the bits of latitude and longitude cells interleaved), so a file
  holds a small area of one year and both a latitude and a longitude range
  skip files;
* the manifest lists every file with its year, its coordinate range and rows;
  :func:`read_current` opens only the files that a box and years can meet;
* the pointer is the file of highest number in ``pointers``: it is written
  beside and renamed, which fails if the number is taken, so a reader sees the
  old version until the new one is whole, a writer that dies leaves it, and of
  two writers one fails.

``publish_years`` replaces only the years that new rows touch: their files are
written anew, the others stay where they are and are listed again.
``vacuum`` removes files that the last versions no longer list.

All of it is Spark writing Parquet plus a few file-system calls on names; the
manifest is a table, one row per file, and only the names of the files a query
opens come to the driver, as for any scan.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import remove

BITS = 20                 # bits of each coordinate: cells of about 20 m by 40 m
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
Box = tuple[float, float, float, float]     # lat min, lat max, lon min, lon max


def morton_key(lat: str | Column, lon: str | Column) -> Column:
    """The bits of the latitude and longitude cells interleaved (long); null
    where a coordinate is null or not finite."""
    def cells(c: str | Column, low: float, span: float) -> Column:
        v = (F.col(c) if isinstance(c, str) else c).cast("double")
        share = (v - F.lit(low)) / F.lit(span)
        whole = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * F.lit(float((1 << BITS) - 1)))
        x = F.when(F.abs(v) < float("inf"), whole.cast("long"))
        for shift, mask in _SPREAD:
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    return cells(lat, -90.0, 180.0).bitwiseOR(F.shiftleft(cells(lon, -180.0, 360.0), 1))


def _fs(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _pointers(spark: SparkSession, root: str) -> list[int]:
    fs, at = _fs(spark, f"{root}/pointers")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def _pointer(spark: SparkSession, root: str, number: int) -> dict:
    fs, at = _fs(spark, f"{root}/pointers/{number:09d}.json")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _point(spark: SparkSession, root: str, number: int, entry: dict) -> None:
    """Make ``entry`` the version ``number``; fails if there is one."""
    fs, aside = _fs(spark, f"{root}/pointers/.{uuid.uuid4()}")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(json.dumps(entry).encode()))
    finally:
        out.close()
    _, target = _fs(spark, f"{root}/pointers/{number:09d}.json")
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise RuntimeError(f"another writer published version {number} of {root}")


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the published versions, oldest first."""
    return _pointers(spark, root)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(file, year, lat_min, lat_max, lon_min, lon_max, n_rows, n_unplaced) of a version."""
    known = _pointers(spark, root)
    if not known:
        raise FileNotFoundError(f"nothing published at {root}")
    return spark.read.schema(MANIFEST).parquet(_pointer(spark, root, known[-1] if version is None else version)["manifest"])


MANIFEST = "file string, year int, lat_min double, lat_max double, lon_min double, lon_max double, n_rows long, n_unplaced long"


def _year(year: str | None) -> Column:
    """The year as the manifest knows it; a table without one has a single part."""
    return F.col(f"`{year}`").cast("int") if year else F.lit(None).cast("int")


def _write(df: DataFrame, folder: str, year: str | None, lat: str, lon: str) -> DataFrame:
    """Write one version's files; their manifest rows.  The input is evaluated
    once: it is written as it comes, and its range partitioning samples that."""
    spark = df.sparkSession
    aside = f"{folder}/aside"
    df.write.parquet(aside)
    stored = spark.read.schema(df.schema).parquet(aside).withColumns({"__year": _year(year), "__morton": morton_key(F.col(f"`{lat}`"), F.col(f"`{lon}`"))})
    placed = stored.repartitionByRange("__year", "__morton").sortWithinPartitions("__year", "__morton").drop("__morton")
    placed.write.partitionBy("__year").parquet(f"{folder}/data")
    remove(spark, aside)
    return _files(spark, f"{folder}/data", df.schema, year, lat, lon)


def _files(spark: SparkSession, data: str, schema: T.StructType, year: str | None, lat: str, lon: str) -> DataFrame:
    """Manifest rows of a folder: reads the three columns only."""
    rows = spark.read.option("recursiveFileLookup", True).schema(schema).parquet(data)
    y, a, b = _year(year), F.col(f"`{lat}`").cast("double"), F.col(f"`{lon}`").cast("double")
    known = F.abs(a).isNotNull() & F.abs(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    return rows.select(F.col("_metadata.file_path").alias("file"), y.alias("year"), F.when(known, a).alias("a"), F.when(known, b).alias("b")).groupBy("file").agg(
        F.min("year").alias("year"), F.min("a").alias("lat_min"), F.max("a").alias("lat_max"), F.min("b").alias("lon_min"),
        F.max("b").alias("lon_max"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("a").isNull()).alias("n_unplaced"))


def _publish(df: DataFrame, root: str, keep: DataFrame | None, expected: int | None, year: str | None, lat: str, lon: str) -> int:
    spark = df.sparkSession
    number = (_pointers(spark, root) or [0])[-1] + 1 if expected is None else expected + 1
    folder = f"{root}/v-{uuid.uuid4()}"
    listed = _write(df, folder, year, lat, lon)
    if keep is not None:
        listed = keep.unionByName(listed)
    listed.coalesce(1).write.parquet(f"{folder}/manifest")
    _point(spark, root, number, {"manifest": f"{folder}/manifest", "schema": df.schema.json(), "columns": [year, lat, lon]})
    return number


def publish(df: DataFrame, root: str, year: str | None = "Occured_Year", lat: str = "LAT", lon: str = "LON", expected: int | None = None) -> int:
    """``df`` as the new current version of the table at ``root``; its number.
    ``year`` None: a table without a year column.
    ``expected`` is the version the rows were derived from (by default the
    current one when writing begins): if another was published meanwhile, this fails."""
    current = _pointers(df.sparkSession, root)
    return _publish(df, root, None, expected if expected is not None else (current[-1] if current else 0), year, lat, lon)


def publish_years(df: DataFrame, root: str, expected: int | None = None) -> int:
    """A new version in which the years that ``df`` holds are those of ``df``
    and all others stay; null years are one year.  Files of other years are
    neither read nor written."""
    spark = df.sparkSession
    current = _pointers(spark, root)
    if not current:
        return publish(df, root, expected=expected)
    entry = _pointer(spark, root, current[-1])
    if T.StructType.fromJson(json.loads(entry["schema"])).names != df.columns:
        raise ValueError("columns differ from the published table's")
    year, lat, lon = entry["columns"]
    if year is None:
        raise ValueError("the published table has no year column")
    number = current[-1] if expected is None else expected
    touched = [r["year"] for r in df.select(_year(year).alias("year")).distinct().collect()]  # years, a handful
    listed = manifest(spark, root, current[-1])
    same = F.col("year").isin([y for y in touched if y is not None])
    gone = F.coalesce(same, F.lit(None in touched))
    return _publish(df, root, listed.where(~gone), number, year, lat, lon)


def read_current(spark: SparkSession, root: str, box: Box | None = None, years: Sequence[int] = (), version: int | None = None) -> DataFrame:
    """The current version (or ``version``), whole or the rows in ``box`` (edges
    included) and ``years``; only files that can hold such rows are opened."""
    known = _pointers(spark, root)
    if not known:
        raise FileNotFoundError(f"nothing published at {root}")
    entry = _pointer(spark, root, known[-1] if version is None else version)
    schema = T.StructType.fromJson(json.loads(entry["schema"]))
    if years and entry["columns"][0] is None:
        raise ValueError("the published table has no year column")
    year, lat, lon = (F.col(f"`{c}`") if c else F.lit(None) for c in entry["columns"])
    files = spark.read.schema(MANIFEST).parquet(entry["manifest"])
    rows = F.lit(True)
    if years:
        files, rows = files.where(F.col("year").isin(*years)), rows & year.isin(*years)
    if box is not None:
        a, b, c, d = (float(v) for v in box)
        files = files.where((F.col("lat_max") >= a) & (F.col("lat_min") <= b) & (F.col("lon_max") >= c) & (F.col("lon_min") <= d))
        rows = rows & lat.between(a, b) & lon.between(c, d)
    names = sorted(r["file"] for r in files.select("file").collect())
    if not names:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(*names)
    return found.where(rows) if years or box is not None else found


def published_years(spark: SparkSession, root: str) -> list[int]:
    """The years of the current version, latest first, from the manifest alone."""
    years = manifest(spark, root).select("year").where("year IS NOT NULL").distinct()
    return sorted((r["year"] for r in years.collect()), reverse=True)


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Remove version folders whose files the last ``keep`` versions do not
    list, and older pointers; the number of folders removed.  Not to be run
    while a reader still uses an older version or a writer is at work."""
    known = _pointers(spark, root)
    live, old = known[-keep:], known[:-keep]
    used: set[str] = set()
    for number in live:
        entry = _pointer(spark, root, number)
        folders = spark.read.schema(MANIFEST).parquet(entry["manifest"]).select(F.regexp_extract("file", "/(v-[0-9a-f-]+)/", 1).alias("v")).distinct()
        used |= {r["v"] for r in folders.collect()} | {entry["manifest"].split("/")[-2]}
    fs, at = _fs(spark, root)
    gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in used]
    for number in old:
        remove(spark, f"{root}/pointers/{number:09d}.json")
    for path in gone:
        fs.delete(path, True)
    return len(gone)
