"""Batch pipeline: raw incident and tract CSVs -> cleaned, region-mapped,
income-enriched Parquet, partitioned by year so year filters prune folders.

Every step is lazy; the actions are the writes.  Intermediate results are
handed over as DataFrames or under one configured root, never by re-reading
hand-moved files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T

from ..operators import clean as C
from ..operators import enrich as J
from ..schemas import RAW_INCIDENT, RAW_TRACT
from ..sources import files as S


def enriched_from_frames(raw_incidents: DataFrame, raw_tracts: DataFrame, fanout: bool = False) -> DataFrame:
    return enriched_from_clean(C.clean_incidents(raw_incidents), C.clean_tracts(raw_tracts), fanout)


def enriched_from_clean(clean: DataFrame, tracts: DataFrame, fanout: bool = False) -> DataFrame:
    join = J.enrich_fanout if fanout else J.enrich_region
    return join(C.map_area_to_region(clean), tracts)


def _read_once(spark: SparkSession, csv: str, schema: T.StructType, out_root: str, name: str, key: str) -> tuple[DataFrame, dict[str, int]]:
    """The one pass over a CSV: rows typed, unparsed texts kept beside them,
    both counted by the job that stores them; the stored typed rows and the counts."""
    checked = S.read_checked(spark, csv, schema)
    seen = Observation(name)
    staged = f"{out_root}/staged/{name}"
    checked.observe(seen, *S.reject_metrics(schema, checked.columns)).write.mode("overwrite").parquet(staged)
    typed, rejects = S.split_rejects(spark.read.schema(checked.schema).parquet(staged), key if key in checked.columns else None)
    rejects.write.mode("overwrite").parquet(f"{out_root}/{name}_rejected")
    return typed, seen.get


def run_batch_pipeline(spark: SparkSession, incidents_csv: str, tracts_csv: str, out_root: str,
                       fanout: bool = False, clean_csv: bool = False) -> str:
    """Clean + enrich and write, under ``out_root``:

    * ``incidents_clean`` - the cleaned incidents (Parquet by ``Occured_Year``;
      with ``clean_csv`` also as CSV, one file per task - a single file would
      funnel the table through one task),
    * ``tracts_clean`` - the cleaned tracts (CSV, one file per task),
    * ``enriched`` - incidents with region income (Parquet by
      ``Occured_Year``, sorted by latitude inside each file),
    * ``incidents_rejected``, ``tracts_rejected`` - a row per value that did not
      parse, with its text and its typed row (the row itself goes on, with null there),
    * ``read_report`` - rows read and rejects per table and column.

    Returns the enriched path.  Each CSV is parsed once, by the job that stores
    its typed rows; cleaning, range partitioning (which samples its input) and
    the reject tables read that Parquet, which is removed at the end, and what
    follows reads the clean table, so a lost executor recomputes its own
    partitions from there."""
    incidents, inc_seen = _read_once(spark, incidents_csv, RAW_INCIDENT, out_root, "incidents", "DR_NO")
    raw_tracts, tr_seen = _read_once(spark, tracts_csv, RAW_TRACT, out_root, "tracts", "tract")
    report = [(t, k, int(v)) for t, seen in (("incidents", inc_seen), ("tracts", tr_seen)) for k, v in seen.items()]
    spark.createDataFrame(report, "table_name string, metric string, value long").coalesce(1).write.mode("overwrite").parquet(f"{out_root}/read_report")
    clean = C.clean_incidents(incidents)
    S.write_table(clean, f"{out_root}/incidents_clean", partition_by=["Occured_Year"], sort_by=["LAT", "LON"], aside=False)
    stored = S.read_table(spark, f"{out_root}/incidents_clean").select(*clean.columns)
    if clean_csv:
        S.write_csv(stored, f"{out_root}/incidents_clean_csv")
    tracts = C.clean_tracts(raw_tracts)
    S.write_csv(tracts, f"{out_root}/tracts_clean")
    enriched = enriched_from_clean(stored, tracts, fanout)
    out = f"{out_root}/enriched"
    S.write_table(enriched, out, partition_by=["Occured_Year"], sort_by=["LAT", "LON"], aside=False)
    S.remove(spark, f"{out_root}/staged")
    return out
