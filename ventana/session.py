"""Session construction and lineage-cutting helpers.

Everything in the library is lazy DataFrame code; this module only holds the
settings the operators rely on (UTC session clock, ANSI on, AQE on) and the
shared checkpoint folder used to cut long lineages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app_name: str = "ventana",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Return (or reuse) a session with the library defaults applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(total_cores: int, *, scan_split: str = "256m", shuffle_target: str = "128m",
                 broadcast_limit: str = "64m") -> dict:
    """Settings for a large cluster (e.g. 1000 executors x 8 cores on ~100 TB).

    * Scans: ``maxPartitionBytes`` sets the split size, so tasks read ~256 MB of
      Parquet each (column pruning shrinks that further).
    * Shuffles in this library carry aggregated grids or partial aggregates, far
      smaller than the input; start from 4 x cores partitions and let AQE
      coalesce to ~128 MB each (``parallelismFirst`` off so it honours the
      size, not the core count).
    * Broadcasts are decided by AQE on measured sizes (``autoBroadcastJoinThreshold``
      is checked at run time), never forced on data that grows.
    * Skewed join partitions (> 3 x median and > 256 MB) are split by AQE.
    """
    return {
        "spark.sql.files.maxPartitionBytes": scan_split,
        "spark.sql.shuffle.partitions": str(max(200, 4 * total_cores)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": shuffle_target,
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": broadcast_limit,
        "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
        "spark.task.maxFailures": "8",
        "spark.stage.maxConsecutiveAttempts": "8",
    }


def require_shared(folder: str, master: str) -> None:
    """Refuse a folder of one machine's own disk where executors run on others."""
    if not master.startswith("local") and (folder.startswith("file:") or "://" not in folder and folder.startswith("/")):
        raise ValueError(f"{folder} lies on one machine; set spark.checkpoint.dir to a folder that all executors reach")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and materialised intermediate tables.

    On a cluster this is the folder named by ``spark.checkpoint.dir``, which
    every executor can reach; it is only read from the session. Where nothing
    is configured (local tests), a folder named after the application is made
    inside the session's warehouse, which Spark already needs every executor to
    reach, and removed when the session's file system closes.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    require_shared(warehouse, spark.sparkContext.master)
    folder = f"{warehouse.rstrip('/')}/_scratch-{spark.sparkContext.applicationId}"
    remove_at_exit(spark, folder)
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _hadoop_path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Make ``path`` and have its file system remove it when the application ends."""
    fs, jpath = _hadoop_path(spark, path)
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, on any file system Spark can read; other errors are raised."""
    fs, jpath = _hadoop_path(spark, path)
    return fs.exists(jpath)


def has_file(spark: SparkSession, path: str, suffix: str) -> bool:
    """Whether a file whose name ends in ``suffix`` lies anywhere below ``path``."""
    fs, jpath = _hadoop_path(spark, path)
    if not fs.exists(jpath):
        return False
    files = fs.listFiles(jpath, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(suffix):
            return True
    return False


def remove_path(spark: SparkSession, path: str) -> None:
    fs, jpath = _hadoop_path(spark, path)
    fs.delete(jpath, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder and read back, for rows that several jobs read."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Survives executor loss (unlike a local checkpoint): the data is written to
    the shared folder, and the plan above it is dropped.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)

