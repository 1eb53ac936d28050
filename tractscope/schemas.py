"""Schemas and fixed values of the incident and tract data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the source application's for equal answers.
# ---------------------------------------------------------------------------

# Police area -> health-service region ("SPA"), in the source's order.
AREA_TO_REGION: dict[str, str] = {
    "Central": "SPA 4 - Metro",
    "Rampart": "SPA 4 - Metro",
    "Newton": "SPA 4 - Metro",
    "Hollenbeck": "SPA 4 - Metro",
    "77th Street": "SPA 6 - South",
    "Southwest": "SPA 6 - South",
    "Southeast": "SPA 6 - South",
    "Hollywood": "SPA 5 - West",
    "Wilshire": "SPA 5 - West",
    "West LA": "SPA 5 - West",
    "Pacific": "SPA 5 - West",
    "Van Nuys": "SPA 2 - San Fernando",
    "West Valley": "SPA 2 - San Fernando",
    "North Hollywood": "SPA 2 - San Fernando",
    "Foothill": "SPA 2 - San Fernando",
    "Devonshire": "SPA 2 - San Fernando",
    "Mission": "SPA 2 - San Fernando",
    "Topanga": "SPA 2 - San Fernando",
    "Northeast": "SPA 4 - Metro",
}
OTHER_REGION = "Other"
LOW_INCOME = "Low Income"

# 12-hour date text of the incident file.
DATE_PATTERN = "MM/dd/yyyy hh:mm:ss a"

# City bounding box: lat_min, lat_max, lon_min, lon_max (inclusive).
CITY_BOX = (33.5, 34.5, -119.0, -117.0)

EARTH_RADIUS_KM = 6371.0

# Day is 6 <= hour < 18; everything else (null hour too) is night.
DAY_START_HOUR = 6
DAY_END_HOUR = 18

# Column headers and types of the two input files.
RAW_INCIDENT = T.StructType(
    [
        T.StructField("DR_NO", T.LongType(), False),
        T.StructField("Date Rptd", T.StringType()),
        T.StructField("DATE OCC", T.StringType()),
        T.StructField("TIME OCC", T.IntegerType()),
        T.StructField("AREA NAME", T.StringType()),
        T.StructField("Crm Cd Desc", T.StringType()),
        T.StructField("Vict Age", T.IntegerType()),
        T.StructField("Vict Descent", T.StringType()),
        T.StructField("Premis Desc", T.StringType()),
        T.StructField("Weapon Used Cd", T.IntegerType()),
        T.StructField("Weapon Desc", T.StringType()),
        T.StructField("LAT", T.DoubleType()),
        T.StructField("LON", T.DoubleType()),
    ]
)

RAW_TRACT = T.StructType(
    [
        T.StructField("tract", T.LongType(), False),
        T.StructField("spa", T.StringType(), False),
        T.StructField("med_hh_income", T.DoubleType()),
        T.StructField("ami_category", T.StringType()),
    ]
)
# ---------------------------------------------------------------------------
