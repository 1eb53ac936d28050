"""A stored count cube: filtered reports without reading incidents.

The incidents are aggregated once by ``GROUPING SETS`` into *levels* (sets of
dimensions) with additive measures: rows, fan-out multiplicities, and sums and
counts of ages, weapons and incomes.  A report by some keys under some choices
is answered from the level with the fewest rows that holds all its keys and
chosen dimensions (:meth:`CountCube.rows`); the choices become plain filters on
that level, the level itself a folder, so other levels are not read.

Null is a value of a dimension like any other: a level's rows lie in its own
folder, so a null there never means "all".  The report's choices (``isin``)
drop null values, as on the incidents.

Scale: one pass over the incidents; the fine levels' rows are expanded in the
map task and combined there before the shuffle, so each task sends at most one
row per group it met.  Coarser levels are rolled up from the stored finer ones.
New incidents are added by merging cubes (:func:`merge`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as X
from . import summary as A
from .enrich import FANOUT_INCOME_N, FANOUT_INCOME_SUM, FANOUT_WEIGHT

CHOICES = ("spa", "Occured_Year", "Occured_Month")
REPORT_DIMS = ("Hour", "Crm_Cd_Desc", "Vict_Descent", "AREA_NAME", "Premis_Desc", "Has_Weapon", "Weapon_Desc")
DIMS = CHOICES + REPORT_DIMS
#: Built from the incidents: the choices with each report dimension.
FINE_LEVELS: tuple[tuple[str, ...], ...] = tuple((*CHOICES, d) for d in REPORT_DIMS)
#: Rolled up from those: the choices alone, each dimension alone, by year, and by region.
COARSE_LEVELS: tuple[tuple[str, ...], ...] = (
    CHOICES, (), *((d,) for d in DIMS), *(("Occured_Year", d) for d in ("spa", *REPORT_DIMS)), *(("spa", d) for d in REPORT_DIMS))

#: Additive measures of a row: plain, and as J1 would repeat it (``fan_``).
MEASURES = ("n", "age_sum", "age_n", "weapon_n", "income_sum", "income_n",
            "fan_n", "fan_age_sum", "fan_age_n", "fan_weapon_n", "fan_income_sum", "fan_income_n")


def level_name(dims: Sequence[str]) -> str:
    """The folder of a level: its dimensions in the order of ``DIMS``."""
    return "+".join(sorted(dims, key=DIMS.index)) or "all"


def with_measures(df: DataFrame) -> DataFrame:
    """Dimensions and measures of each incident of an enriched frame; the
    ``fan_`` measures need :func:`enrich.enrich_fanout_weighted` and are those
    of a plain row without it."""
    weighted = FANOUT_WEIGHT in df.columns
    w = F.col(FANOUT_WEIGHT) if weighted else F.lit(1).cast("long")
    age, armed = F.col("Vict_Age").cast("long"), F.col("Weapon_Used_Cd").isNotNull().cast("long")
    one, aged = F.lit(1).cast("long"), F.col("Vict_Age").isNotNull().cast("long")
    income = F.col("med_hh_income").cast("double")
    paid = income.isNotNull().cast("long")
    return df.select(
        *CHOICES, *[d for d in REPORT_DIMS if d != "Has_Weapon"], X.weapon_flag("Weapon_Used_Cd").alias("Has_Weapon"),
        one.alias("n"), age.alias("age_sum"), aged.alias("age_n"), armed.alias("weapon_n"), income.alias("income_sum"), paid.alias("income_n"),
        w.alias("fan_n"), (age * w).alias("fan_age_sum"), (aged * w).alias("fan_age_n"), (armed * w).alias("fan_weapon_n"),
        (F.col(FANOUT_INCOME_SUM) if weighted else income).alias("fan_income_sum"),
        (F.col(FANOUT_INCOME_N) if weighted else paid).alias("fan_income_n"))


def _sums() -> list:
    return [F.sum(m).alias(m) for m in MEASURES]


def build(df: DataFrame, levels: Sequence[Sequence[str]] = FINE_LEVELS) -> DataFrame:
    """The levels of an enriched frame, in one pass: (level, dimensions, measures)."""
    dims = [d for d in DIMS if any(d in lv for lv in levels)]
    grouped = with_measures(df).groupingSets([[F.col(d) for d in lv] for lv in levels], *[F.col(d) for d in dims])
    rows = grouped.agg(F.grouping_id().alias("gid"), *_sums())
    # bit i (from the right) of the grouping id is set where the i-th dimension from the right is rolled up
    names = {sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in lv): level_name(lv) for lv in levels}
    level = F.coalesce(*[F.when(F.col("gid") == g, F.lit(name)) for g, name in names.items()])
    kinds = dict(df.dtypes)
    return rows.select(level.alias("level"), *[(F.col(d) if d in dims else F.lit(None).cast(kinds.get(d, "string"))).alias(d) for d in DIMS],
                       *MEASURES)


def _rolled(rows: DataFrame, name: str, dims: Sequence[str]) -> DataFrame:
    kinds = dict(rows.dtypes)
    grouped = rows.groupBy(*[d for d in DIMS if d in dims]).agg(*_sums())
    return grouped.select(F.lit(name).alias("level"), *[(F.col(d) if d in dims else F.lit(None).cast(kinds[d])).alias(d) for d in DIMS], *MEASURES)


@dataclass(frozen=True)
class CountCube:
    """Stored levels: ``table`` (partitioned by ``level``) and each level's number of rows."""
    table: DataFrame
    sizes: Mapping[tuple[str, ...], int]
    base: DataFrame | None = field(default=None, compare=False)

    def fitting(self, dims: Sequence[str]) -> tuple[str, ...] | None:
        """The level of fewest rows that holds all of ``dims`` (ties: fewest
        dimensions, then its name); None if no level does."""
        fit = [lv for lv in self.sizes if set(dims) <= set(lv)]
        return min(fit, key=lambda lv: (self.sizes[lv], len(lv), level_name(lv)), default=None)

    def rows(self, keys: Sequence[str] = (), regions: Sequence[str] = (), years: Sequence[int] = (), months: Sequence[int] = (),
             **more: Sequence) -> DataFrame:
        """``keys`` and measures of what the choices leave: from the best
        fitting level, else from the incidents (``base``) if they were given.
        An empty choice means all values; ``more`` chooses among any dimension."""
        chosen = {k: list(v) for k, v in {"spa": regions, "Occured_Year": years, "Occured_Month": months, **more}.items() if len(v)}
        unknown = [d for d in (*keys, *chosen) if d not in DIMS]
        if unknown:
            raise ValueError(f"no dimension: {unknown}")
        level = self.fitting([*keys, *chosen])
        if level is not None:
            found = self.table.where(F.col("level") == level_name(level))
        elif self.base is not None:
            found = with_measures(self.base)
        else:
            raise LookupError(f"no level holds {sorted({*keys, *chosen})}")
        for dim, values in chosen.items():
            found = found.where(F.col(dim).isin(*values))
        return found.select(*keys, *MEASURES)

    def latest_years(self, n: int = 3) -> list[int]:
        """The ``n`` latest years, from the level of years alone."""
        years = self.rows(["Occured_Year"]).select("Occured_Year").where("Occured_Year IS NOT NULL").distinct()
        return [r[0] for r in years.orderBy(F.desc("Occured_Year")).limit(n).collect()]

    def defaults(self, n_years: int = 3) -> dict[str, list[int]]:
        """The report's default choices: the latest years and every listed month."""
        months = self.rows(["Occured_Month"]).select("Occured_Month").where("Occured_Month IS NOT NULL").distinct()
        return {"years": self.latest_years(n_years), "months": sorted(r[0] for r in months.collect())}


def store(df: DataFrame, path: str, fine: Sequence[Sequence[str]] = FINE_LEVELS, coarse: Sequence[Sequence[str]] = COARSE_LEVELS,
          keep_base: bool = False) -> CountCube:
    """Build the cube of an enriched frame under ``path``: one pass over the
    incidents for the fine levels, the coarse ones from the stored fine ones."""
    spark = df.sparkSession
    built = build(df, fine)
    built.write.mode("overwrite").partitionBy("level").parquet(f"{path}/levels")
    _finish(spark, path, fine, coarse, built.schema)
    return load(spark, path, df if keep_base else None)


def _finish(spark: SparkSession, path: str, fine: Sequence[Sequence[str]], coarse: Sequence[Sequence[str]], schema: T.StructType) -> None:
    """Add the coarse levels (that of no dimension has a row even of an empty table) and the sizes."""
    stored = spark.read.schema(schema).parquet(f"{path}/levels")
    counted = {r["level"]: r["count"] for r in stored.groupBy("level").count().collect()}
    sizes = {tuple(lv): counted.get(level_name(lv), 0) for lv in fine}
    parts = []
    for lv in coarse:
        if tuple(lv) in sizes:
            continue
        source = min((f for f in sizes if set(lv) <= set(f)), key=lambda f: sizes[f], default=None)
        if source is None:
            raise ValueError(f"no stored level holds {lv}")
        parts.append(_rolled(stored.where(F.col("level") == level_name(source)), level_name(lv), lv))
    for start in range(0, len(parts), 8):  # a few levels a job
        out = parts[start]
        for p in parts[start + 1:start + 8]:
            out = out.unionByName(p)
        out.write.mode("append").partitionBy("level").parquet(f"{path}/levels")
    _write_sizes(spark, path, [*fine, *coarse])


def _write_sizes(spark: SparkSession, path: str, levels: Sequence[Sequence[str]]) -> None:
    """One row per level, those without rows included."""
    counted = {r["level"]: r["count"] for r in _levels(spark, path).groupBy("level").count().collect()}
    rows = [(name, counted.get(name, 0)) for name in sorted({level_name(lv) for lv in levels})]
    spark.createDataFrame(rows, "level string, count long").coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")


def _levels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/levels")


def load(spark: SparkSession, path: str, base: DataFrame | None = None) -> CountCube:
    """The cube stored under ``path``."""
    sizes = {tuple(r["level"].split("+")) if r["level"] != "all" else (): r["count"] for r in spark.read.parquet(f"{path}/sizes").collect()}
    return CountCube(_levels(spark, path), sizes, base)


def merge(cubes: Sequence[CountCube], path: str) -> CountCube:
    """One cube of several with the same levels (e.g. the stored one and that
    of new incidents): measures add up, no incident is read again."""
    spark = cubes[0].table.sparkSession
    if len({frozenset(c.sizes) for c in cubes}) > 1:
        raise ValueError("cubes of different levels")
    rows = cubes[0].table
    for c in cubes[1:]:
        rows = rows.unionByName(c.table)
    rows.groupBy("level", *DIMS).agg(*_sums()).write.mode("overwrite").partitionBy("level").parquet(f"{path}/levels")
    _write_sizes(spark, path, list(cubes[0].sizes))
    return load(spark, path)


# -- reports -------------------------------------------------------------------
# The reports of ``summary`` under choices; ``fanout`` gives those of the J1 join.

def _n(fanout: bool) -> str:
    return "fan_n" if fanout else "n"


def _ratio(total: str, number: str, fanout: bool):
    pre = "fan_" if fanout else ""
    return F.try_divide(F.sum(pre + total).cast("double"), F.sum(pre + number).cast("double"))


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def count_by(cube: CountCube, keys: str | Sequence[str], n: int | None = None, fanout: bool = False, **choices) -> DataFrame:
    return A.count_by(cube.rows(_keys(keys), **choices), keys, n, _n(fanout))


def top_counts(cube: CountCube, keys: str | Sequence[str], n: int = 10, fanout: bool = False, known: bool = False, **choices) -> DataFrame:
    """With ``known``, groups of a null key are left out."""
    rows = cube.rows(_keys(keys), **choices)
    return A.top_counts(rows.na.drop(subset=_keys(keys)) if known else rows, keys, n, _n(fanout))


def mean_age_by(cube: CountCube, key: str, n: int | None = None, out: str = "mean", fanout: bool = False, **choices) -> DataFrame:
    means = cube.rows([key], **choices).groupBy(key).agg(_ratio("age_sum", "age_n", fanout).alias(out))
    ordered = means.orderBy(F.col(out).desc_nulls_last(), F.col(key).asc_nulls_last())
    return ordered.limit(n) if n else ordered


def share_by(cube: CountCube, keys: str | Sequence[str], fanout: bool = False, **choices) -> DataFrame:
    return A.share_by(cube.rows(_keys(keys), **choices), keys, _n(fanout))


def series_by(cube: CountCube, group: str, order_key: str, fanout: bool = False, **choices) -> DataFrame:
    return A.series_by(cube.rows([group, order_key], **choices), group, order_key, _n(fanout))


def pivot_counts(cube: CountCube, row_key: str, col_key: str, values: Sequence[str], fanout: bool = False, **choices) -> DataFrame:
    return A.pivot_counts(cube.rows([row_key, col_key], **choices), row_key, col_key, values, _n(fanout))


def _profile(fanout: bool) -> list:
    return [F.sum(_n(fanout)).alias("crime_count"), _ratio("income_sum", "income_n", fanout).alias("avg_income"),
            _ratio("age_sum", "age_n", fanout).alias("avg_victim_age"), _ratio("weapon_n", "n", fanout).alias("weapon_rate")]


def income_vs_count(cube: CountCube, fanout: bool = False, **choices) -> DataFrame:
    return cube.rows(["spa"], **choices).groupBy("spa").agg(_ratio("income_sum", "income_n", fanout).alias("avg_income"),
                                                            F.sum(_n(fanout)).alias("crime_count"))


def region_profile(cube: CountCube, fanout: bool = False, **choices) -> DataFrame:
    return cube.rows(["spa"], **choices).where("spa IS NOT NULL").groupBy("spa").agg(*_profile(fanout)).na.drop()


def region_month_panel(cube: CountCube, fanout: bool = False, **choices) -> DataFrame:
    rows = cube.rows(list(CHOICES), **choices).where("spa IS NOT NULL")
    return rows.groupBy(*CHOICES).agg(*_profile(fanout)).na.drop()


def filtered_count(cube: CountCube, fanout: bool = False, **choices) -> DataFrame:
    return cube.rows(**choices).agg(F.coalesce(F.sum(_n(fanout)), F.lit(0)).cast("long").alias("n_rows"))


def selected_regions(cube: CountCube, **choices) -> DataFrame:
    return cube.rows(["spa"], **choices).agg(F.countDistinct("spa").alias("n_regions"))
