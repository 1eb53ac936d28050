"""File sources and sinks (CSV and Parquet)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import parse_money
from ..schemas import RAW_INCIDENT, RAW_TRACT

MONEY_COLUMNS = ("med_hh_income",)


def _typed(name: str, kind: T.DataType) -> Column:
    """Text to ``kind``: money columns through ``parse_money``; whole numbers
    also where they are written as decimals (``400.0``)."""
    c = F.col(f"`{name}`")
    if name in MONEY_COLUMNS:
        return parse_money(c).cast(kind)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        number = c.try_cast("double")
        whole = F.when(number == F.floor(number), number.try_cast(kind))
        return F.coalesce(c.try_cast(kind), whole)
    return c.try_cast(kind)


def type_by_name(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Type the columns named in ``schema`` (values that do not parse become
    null; :func:`unparsed_counts` counts them), keeping every other column
    and the file's column order.

    Spark applies an explicit CSV schema by position, so a file with extra
    or reordered columns would be read wrongly; typing by name avoids it.
    """
    wanted = {f.name: f.dataType for f in schema.fields}
    return df.select(
        *[
            _typed(c, wanted[c]).alias(c) if c in wanted else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def unparsed_counts(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Per typed column: how many non-blank texts would become null, in one
    pass, so that no value is lost unnoticed."""
    fields = [f for f in schema.fields if f.name in raw.columns]
    lost = raw.agg(*[F.count_if((F.trim(F.col(f"`{f.name}`")) != "") & _typed(f.name, f.dataType).isNull()).alias(f"c{i}")
                     for i, f in enumerate(fields)])
    return lost.select(F.inline(F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(f"c{i}").alias("unparsed"))
                                          for i, f in enumerate(fields)])))


def read_incidents_csv(spark: SparkSession, path: str) -> DataFrame:
    """Incident CSV with header; no inference pass over the data."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return type_by_name(raw, RAW_INCIDENT)


def read_tracts_csv(spark: SparkSession, path: str) -> DataFrame:
    """Tract CSV with header, typed by name; income may be money text
    (``$61,994 ``, see ``parse_money``)."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return type_by_name(raw, RAW_TRACT)


REJECTS = "_rejects"   # array<struct<column_name, text>> of a row's values that do not parse


def read_checked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with header typed by name, each row with the texts that did not
    parse (column ``_rejects``, empty where all did), so that reading, counting
    and keeping them is one pass (:func:`split_rejects`, :func:`reject_metrics`)."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    wanted = {f.name: f.dataType for f in schema.fields if f.name in raw.columns}
    lost = [F.when((F.trim(F.col(f"`{n}`")) != "") & _typed(n, k).isNull(), F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").alias("text")))
            for n, k in wanted.items() if not isinstance(k, T.StringType)]
    rejects = F.array_compact(F.array(*lost)) if lost else F.array().cast("array<struct<column_name:string,text:string>>")
    return raw.select(*[_typed(c, wanted[c]).alias(c) if c in wanted else F.col(f"`{c}`") for c in raw.columns], rejects.alias(REJECTS))


def reject_metrics(schema: T.StructType, columns: list[str]) -> list[Column]:
    """Aggregates for ``observe`` on a checked frame: its rows, the rows with a
    reject, and the rejects of each typed column."""
    names = [f.name for f in schema.fields if f.name in columns and not isinstance(f.dataType, T.StringType)]
    hit = lambda n: F.exists(REJECTS, lambda r: r["column_name"] == n)
    return [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size(REJECTS) > 0).alias("n_rejected_rows"),
            *[F.count_if(hit(n)).alias(f"rejected: {n}") for n in names]]


def split_rejects(stored: DataFrame, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(typed rows, reject rows) of a stored checked frame: one reject row per
    value, with the whole typed row beside it (and ``key`` first, if given)."""
    typed = stored.drop(REJECTS)
    each = stored.where(F.size(REJECTS) > 0).withColumn("r", F.explode(REJECTS))
    lead = [F.col(f"`{key}`")] if key else []
    return typed, each.select(*lead, "r.column_name", "r.text", F.struct(*[F.col(f"`{c}`") for c in typed.columns]).alias("row"))


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, wherever Spark stores it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """The values of a partition column from folder names alone: no file is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    found = [unescape(n.partition("=")[2]) for n in names if n.startswith(f"{column}=")]
    return sorted(v for v in found if v != "__HIVE_DEFAULT_PARTITION__")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table (columnar; filters and projections reach the scan)."""
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with header, overwrite.  ``single=True`` writes one part file
    through one task: only for small exports."""
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                sort_by: list[str] | None = None, target_rows: int | None = None, aside: bool = True) -> None:
    """Parquet, overwrite; optional directory partitioning (e.g. by year)
    so filters on it prune whole folders.  (For versions, atomic replacement
    and a layout by area see ``layout.publish``.)

    With both, rows are range-partitioned by ``partition_by`` then ``sort_by``
    (e.g. year, then latitude) and sorted within: a task holds one stretch of
    one or two folders, so files are few and each covers a narrow range that
    range filters can skip.  AQE sizes the tasks; ``target_rows`` caps the
    rows of one file.  Range partitioning samples its input before it moves
    it: the rows are first written ``aside`` as they come, so that ``df`` is
    evaluated once; without, it is evaluated twice (for stored input)."""
    keys = [*(partition_by or []), *(sort_by or [])]
    spare = None
    if partition_by and sort_by:
        if aside:
            spare = f"{path.rstrip('/')}-aside-{uuid.uuid4()}"
            df.write.parquet(spare)
            df = df.sparkSession.read.schema(df.schema).parquet(spare)
        df = df.repartitionByRange(*keys)
    if sort_by:
        df = df.sortWithinPartitions(*keys)
    writer = df.write.mode("overwrite")
    if target_rows:
        writer = writer.option("maxRecordsPerFile", target_rows)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if spare:
        remove(df.sparkSession, spare)
