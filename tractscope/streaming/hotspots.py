"""Running per-cell incident counts over a stream of cleaned incident
files (Parquet drops in a folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import clean as C
from ..operators import spatial as G
from ..sources import layout


def incremental_cell_counts(stream: DataFrame, scale: int = 500) -> DataFrame:
    """The hotspot aggregate of a streaming incident frame: the same
    ``valid_geo`` + grid + count as the batch ``hotspots`` (a top-K is a
    read-time step on the result table)."""
    cells = G.add_grid(C.valid_geo(stream), scale).select("lat_i", "lon_i")
    return (cells.groupBy("lat_i", "lon_i").agg(F.count(F.lit(1)).alias("count"))
            .withColumns({"lat_grid": F.col("lat_i") / F.lit(scale),
                          "lon_grid": F.col("lon_i") / F.lit(scale)}))


def start_cell_counts(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str,
                      checkpoint_dir: str, scale: int = 500, available_now: bool = True) -> StreamingQuery:
    """Read new Parquet files from ``source_dir`` and keep the cell counts
    in ``sink_dir``.  State lives in ``checkpoint_dir`` (shared storage on a
    cluster), so a restarted query resumes after lost executors or drivers;
    each micro-batch publishes the small result table as a new version, so a
    reader (:func:`read_cell_counts`) never meets a half-written one.  A version
    stays until the second batch after it, for readers still at it."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    counts = incremental_cell_counts(stream, scale)

    def _write(batch: DataFrame, _epoch: int) -> None:
        layout.publish(batch, sink_dir, year=None, lat="lat_grid", lon="lon_grid")
        layout.vacuum(batch.sparkSession, sink_dir, keep=2)

    writer = (counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint_dir)
              .foreachBatch(_write))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_cell_counts(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The latest whole result of :func:`start_cell_counts`."""
    return layout.read_current(spark, sink_dir)
