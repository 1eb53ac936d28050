"""Session builder: AQE on, UTC, sized shuffles, no web UI."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Target ~128 MB shuffle partitions after AQE coalescing, and honour that
    # size instead of maximising task count (fewer tiny tasks on a shared
    # cluster; aggregated results coalesce to a few partitions).
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    # AQE coalesces partitions but never adds any: start from many.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2000",
    # Top-n per group up to this n is cut in every map task before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "tractscope",
                  shuffle_partitions: int | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """Create (or fetch) a session with the engine's defaults.

    On a cluster leave ``master`` unset and size ``shuffle_partitions`` to
    the input (AQE coalesces small ones); locally use the core count.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.
    Only a local-mode session without it (tests, a laptop) gets a fresh
    scratch folder; on a cluster a machine-local folder would not survive
    the loss of an executor, so it is an error."""
    sc = spark.sparkContext
    path = sc.getCheckpointDir()
    if path:
        return path
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or object storage)")
        path = tempfile.mkdtemp(prefix="tractscope-ckpt-")
    sc.setCheckpointDir(path)
    return path


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared checkpoint folder, so an
    iterative job survives executor loss without recomputing its input."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
