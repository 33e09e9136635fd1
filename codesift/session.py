"""Session helpers.

The library never creates clusters; it only reads settings from the session it
is given.  ``local_session`` is for tests, benches and the driver entry.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Broadcast only below this many bytes of estimated plan size; the callers
# check the size and fall back to a shuffled join above it.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "codesift") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CODESIFT_DRIVER_MEMORY", "16g"))
        .config("spark.sql.legacy.javaCharsets", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cluster_conf(input_tb: float = 100.0, executors: int = 1000, cores_per_executor: int = 4) -> dict:
    """Suggested settings for a large cluster run (apply on the session
    builder; the library itself only reads the session it is given).

    Partitions are sized for ~128 MiB of input per task and ~200 MiB of
    shuffle per reducer, so tasks stay in executor memory and spill is the
    exception; AQE coalesces small partitions and splits skewed ones.
    """
    input_bytes = input_tb * 1024 ** 4
    reducers = max(executors * cores_per_executor * 2, int(input_bytes / (200 * 1024 ** 2)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 ** 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.shuffle.partitions": str(reducers),
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 ** 2),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 ** 2),
        "spark.sql.legacy.javaCharsets": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # rows of the Python adapters are whole files: keep Arrow batches small
        "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared folder and is used as is.  Only
    on a local master may it be unset; then one is made under the temp dir.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="codesift-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Reliable checkpoint (never localCheckpoint): survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df, name: str = "table"):
    """Write ``df`` as parquet under the shared checkpoint folder and read it
    back: cuts lineage (survives executor loss), and later reads get column
    pruning and predicate pushdown.  Used for tables that several branches
    of one plan read (e.g. the target function store)."""
    import uuid

    base = ensure_checkpoint_dir(df.sparkSession)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_text_file(spark, path: str, text: str) -> None:
    """Write one small text file (a signature catalogue, a store index file)
    through the Hadoop FileSystem API, so the path may be on any filesystem
    Spark can read (local, HDFS, object stores) — never via driver-local I/O."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
