"""Profiling and schema inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import impute_income


def schema_table(df: DataFrame) -> DataFrame:
    """Column names and types as rows (metadata only, no job)."""
    return df.sparkSession.createDataFrame(df.dtypes, "column_name string, data_type string")


def table_shape(df: DataFrame) -> DataFrame:
    """Row count (one aggregate job) and column count (metadata)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def preview(df: DataFrame, n: int = 20, key: str = "DR_NO") -> DataFrame:
    """First ``n`` rows by ``key`` (deterministic, unlike ``limit``; the key
    must be non-null), with a bounded final merge."""
    from .rank import first_k_by
    return first_k_by(df, key, n)


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and percent of every column, from ONE pass over the data,
    unpivoted to one row per column."""
    cols = df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"__c{i}") for i, c in enumerate(cols)],
    )
    rows = F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"__c{i}").alias("null_count"))
        for i, c in enumerate(cols)
    ]))
    return counts.select("__n", rows).select(
        "column_name",
        F.coalesce(F.col("null_count"), F.lit(0)).alias("null_count"),
        F.try_divide(F.lit(100.0) * F.coalesce(F.col("null_count"), F.lit(0)), F.col("__n")).alias("null_pct"),
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts of non-null values, most frequent first."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(col)))


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns present in both tables, in ``a``'s order (metadata only)."""
    other = set(b.columns)
    return [c for c in a.columns if c in other]


def distinct_values(df: DataFrame, col: str, limit: int | None = None) -> DataFrame:
    """Sorted distinct non-null values (the first ``limit``, if given)."""
    out = df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)
    return out if limit is None else out.limit(limit)


def imputed_sample(tracts: DataFrame, n: int = 20, key: str = "tract") -> DataFrame:
    """Tracts whose income was filled in, first ``n`` by key."""
    flagged = impute_income(tracts, flag="was_imputed")
    return flagged.filter("was_imputed").orderBy(key).limit(n)


def partition_info(df: DataFrame) -> int:
    """Input partition count (the one place an RDD handle is used)."""
    return df.rdd.getNumPartitions()
