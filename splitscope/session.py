"""SparkSession construction for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this library relies on; a cluster session may set more.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # coalesce shuffle partitions to the advisory size, not to one per core
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "splitscope") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPLITSCOPE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # no per-call Python call-site capture (three JVM round trips per column function)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    # Local mode has 8 cores and small inputs: 8 MB advisory partitions keep
    # CPU-bound stages (join + projection + parquet encoding) spread over the
    # cores while tiny stages still coalesce to one task. A cluster session
    # keeps its own (larger) advisory size.
    advisory = os.environ.get("SPLITSCOPE_ADVISORY_PARTITION_SIZE", "8m")
    builder = builder.config("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    log_dir = os.environ.get("SPLITSCOPE_EVENT_LOG_DIR")
    if log_dir:  # stage/task timings for profiling, written to a scratch folder
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{log_dir}")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; it is used
    as is. Only when it is unset and the master is local (tests) do we create one under /tmp.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        conf_dir = tempfile.mkdtemp(prefix="splitscope-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage by writing a parquet table into the shared checkpoint folder.

    The data lands on the cluster's shared storage, so a lost executor re-reads
    it instead of recomputing the upstream plan. Unlike an RDD checkpoint
    (which runs the plan once to count and again to write), the plan runs
    once, the table is columnar, and its real size feeds AQE's join choices.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/splitscope-tables/{name}-{uuid.uuid4().hex}"


def delete_paths(spark: SparkSession, *paths: str) -> None:
    """Delete files or folders of any store that Spark reaches; missing ones are left."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized for a cluster run over `input_bytes` of session data.

    - file splits of `target_partition_bytes`, so a scan task reads one
      executor-sized block;
    - shuffle partitions at least one per target-sized block of input (the
      dedupe shuffles the whole raw table) and a whole number of waves of the
      cluster's cores; AQE coalesces the small shuffles after aggregation back
      to the advisory size, and splits skewed join partitions.
    The pieces of a value histogram (operators/quantiles.py) follow the shuffle partitions.
    """
    blocks = max(1, -(-input_bytes // target_partition_bytes))
    waves = max(1, -(-blocks // max(1, total_cores)))
    partitions = waves * max(1, total_cores)
    conf = dict(REQUIRED_CONF)
    conf.update({
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    })
    return conf
