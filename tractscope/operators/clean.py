"""Cleaning projections and filters (C1-C19): narrow, shuffle-free."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..schemas import CITY_BOX, LOW_INCOME

DATE_COLUMNS = {"DATE_OCC": "Date_Occured", "Date_Rptd": "Date_Reported"}


def standardize_columns(df: DataFrame) -> DataFrame:
    """Replace spaces in every column name by ``_`` in one projection;
    raise if two columns would get the same name."""
    new = [c.replace(" ", "_") for c in df.columns]
    seen: dict[str, str] = {}
    for old, name in zip(df.columns, new):
        if name in seen:
            raise ValueError(f"columns {seen[name]!r} and {old!r} both become {name!r}")
        seen[name] = old
    return df.toDF(*new)


def parse_dates(df: DataFrame, columns: Mapping[str, str] = DATE_COLUMNS) -> DataFrame:
    """Parse the 12-hour date texts to ``DateType`` (bad text -> null)."""
    return df.withColumns({out: X.parse_date_text(src) for src, out in columns.items()})


def add_date_parts(df: DataFrame, date_col: str, prefix: str) -> DataFrame:
    """``{prefix}_Year``, ``{prefix}_Month``, ``{prefix}_Day`` of a date."""
    d = F.col(date_col)
    return df.withColumns({
        f"{prefix}_Year": F.year(d),
        f"{prefix}_Month": F.month(d),
        f"{prefix}_Day": F.dayofmonth(d),
    })


def add_hour(df: DataFrame, src: str = "TIME_OCC", out: str = "Hour") -> DataFrame:
    return df.withColumn(out, X.hour_from_hhmm(src))


def add_weapon_flag(df: DataFrame, src: str = "Weapon_Used_Cd", out: str = "Weapon_Used") -> DataFrame:
    return df.withColumn(out, X.weapon_flag(src))


def drop_zero_coords(df: DataFrame, lat: str = "LAT", lon: str = "LON") -> DataFrame:
    """Drop unknown points: 0 on either axis (null fails the test too)."""
    return df.filter((F.col(lat) != 0) & (F.col(lon) != 0))


def drop_invalid_age(df: DataFrame, col: str = "Vict_Age") -> DataFrame:
    """Keep victim ages above 0 (null is dropped)."""
    return df.filter(F.col(col) > 0)


def impute_income(tracts: DataFrame, group: str = LOW_INCOME, col: str = "med_hh_income",
                  category: str = "ami_category", flag: str | None = None) -> DataFrame:
    """Fill every null income with the mean income of the ``group``
    category.  The mean is a scalar subquery: Spark runs it once and folds
    the value in, with no join and no single-partition window."""
    group_mean = tracts.select(F.avg(F.when(F.col(category) == group, F.col(col)))).scalar()
    out = tracts
    if flag:
        out = out.withColumn(flag, F.col(col).isNull())
    return out.withColumn(col, F.coalesce(F.col(col), group_mean))


def tract_to_string(df: DataFrame, col: str = "tract") -> DataFrame:
    return df.withColumn(col, F.col(col).cast("string"))


def trim_region(df: DataFrame, col: str = "spa") -> DataFrame:
    """Strip leading/trailing white space (tabs and newlines too)."""
    return df.withColumn(col, F.regexp_replace(F.col(col), r"^\s+|\s+$", ""))


def valid_geo(df: DataFrame, box: tuple[float, float, float, float] = CITY_BOX,
              lat: str = "LAT", lon: str = "LON") -> DataFrame:
    """Add ``LAT_d``/``LON_d`` doubles and keep points inside ``box``
    (inclusive).  A plain ``between`` reaches the Parquet scan as pushed
    filters; a 0/1 flag compared to 1 would not."""
    lat_min, lat_max, lon_min, lon_max = box
    out = df.withColumns({"LAT_d": F.col(lat).cast("double"), "LON_d": F.col(lon).cast("double")})
    return out.filter(F.col("LAT_d").between(lat_min, lat_max) & F.col("LON_d").between(lon_min, lon_max))


def geo_flag(df: DataFrame, box: tuple[float, float, float, float] = CITY_BOX,
             lat: str = "LAT", lon: str = "LON") -> DataFrame:
    """Keep every row and add ``geo_valid`` 1/0 (null point -> 0)."""
    lat_min, lat_max, lon_min, lon_max = box
    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    inside = la.between(lat_min, lat_max) & lo.between(lon_min, lon_max)
    return df.withColumns({
        "LAT_d": la, "LON_d": lo,
        "geo_valid": F.when(inside, F.lit(1)).otherwise(F.lit(0)),
    })


def map_area_to_region(df: DataFrame, src: str = "AREA_NAME", out: str = "spa") -> DataFrame:
    return df.withColumn(out, X.region_of_area(src))


def add_day_part(df: DataFrame, hour: str = "Hour", out: str = "day_part") -> DataFrame:
    return df.withColumn(out, X.day_part(hour))


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=subset)


def region_not_null(df: DataFrame, col: str = "spa") -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def clean_incidents(raw: DataFrame) -> DataFrame:
    """Raw incident rows to CLEAN_INCIDENT in one lazy chain of projections
    and filters (Catalyst collapses it into one stage)."""
    return (
        standardize_columns(raw)
        .transform(parse_dates)
        .transform(add_date_parts, "Date_Occured", "Occured")
        .transform(add_hour)
        .transform(drop_zero_coords)
        .transform(drop_invalid_age)
        .transform(add_weapon_flag)
    )


def clean_tracts(raw: DataFrame, flag: str | None = None) -> DataFrame:
    """Impute income, tract id to text, trim the region label."""
    return impute_income(raw, flag=flag).transform(tract_to_string).transform(trim_region)
