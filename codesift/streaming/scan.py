"""Incremental (I1) and streaming (I2) scans.

I1 keys its state on ``(path, sha256)``: an edited file is rescanned (the
reference keys on the path alone and never invalidates), a removed file's
results leave the state.  ``scan_incremental`` is the step between two states;
``IncrementalScan`` keeps them as numbered versions under a folder.  A version is
written whole to its own folder, and the last thing written is its manifest
row, so a job that dies on the way leaves the previous version in force.

I2 runs the same stateless detectors on files (or inline code rows) as they
arrive, through Structured Streaming.  Each micro-batch is written to its
own ``batch_id=<n>`` folder in overwrite mode, so a replayed batch after a
failure rewrites the same output (exactly-once at the sink); progress lives
in the checkpoint location, which on a cluster must be a shared folder.  With
``distinct_within`` content seen before is scanned only once: its sha256 is
state of the stream, kept until the watermark has passed.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.files import decode_text, use_cp949

BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"
Detector = Callable[[DataFrame], DataFrame]


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows that the optimizer knows to be empty, so joins with
    it shuffle nothing."""
    return spark.createDataFrame([], schema).where(F.lit(False))


def scan_incremental(files: DataFrame, state_files: DataFrame, state_results: DataFrame,
                     detect: Detector) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``files(path, sha256, content)``; state = files scanned before and
    their results (with ``path, sha256``).  Returns ``(results, new_state_files,
    fresh_results)`` where ``results`` covers every current file."""
    key = ["path", "sha256"]
    # written once: every detector reads it, and each would join the contents again
    todo = materialize(files.join(state_files.select(*key), key, "left_anti"), "todo")
    fresh = detect(todo.select("path", "content"))
    fresh = fresh.join(todo.select(*key), "path")
    kept = state_results.join(files.select(*key), key, "left_semi")
    return kept.unionByName(fresh), files.select(*key), fresh


class IncrementalScan:
    """I1 with versioned state under ``root``.

    ``results/v<n>`` and ``files/v<n>`` hold version n, ``manifest/v<n>`` one row
    about it: version, n_files, n_scanned, n_kept, n_removed.  The state in
    force is that of the largest version in the manifest.
    """

    FILES = "path string, sha256 string"
    MANIFEST = "version int, n_files bigint, n_scanned bigint, n_kept bigint, n_removed bigint"

    def __init__(self, spark: SparkSession, root: str, result_schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), f"{result_schema}, sha256 string"

    def manifest(self) -> DataFrame:
        """One row per complete version."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return self.spark.createDataFrame([], self.MANIFEST)
        return self.spark.read.schema(self.MANIFEST).option("recursiveFileLookup", "true").parquet(str(path.toString()))

    def version(self) -> int:
        """The version in force, 0 if there is none."""
        return self.manifest().agg(F.max("version")).first()[0] or 0

    def state(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(files, results) of a version, by default the one in force."""
        n = self.version() if version is None else version
        if n == 0:
            return empty(self.spark, self.FILES), empty(self.spark, self.schema)
        return (self.spark.read.schema(self.FILES).parquet(f"{self.root}/files/v{n}"),
                self.spark.read.schema(self.schema).parquet(f"{self.root}/results/v{n}"))

    def update(self, files: DataFrame, detect: Detector) -> DataFrame:
        """Scan what is new or edited among ``files(path, sha256, content)``,
        the whole corpus as it is now, and switch to a new version; returns its
        results."""
        n = self.version() + 1
        before, old = self.state(n - 1)
        results, now, _fresh = scan_incremental(files, before, old, detect)
        # a folder that a failed attempt left behind is written over
        results.select(old.columns).write.mode("overwrite").parquet(f"{self.root}/results/v{n}")
        now.write.mode("overwrite").parquet(f"{self.root}/files/v{n}")
        now = self.spark.read.schema(self.FILES).parquet(f"{self.root}/files/v{n}")
        both = now.withColumn("new", F.lit(1)).unionByName(before.withColumn("new", F.lit(0))) \
            .groupBy("path", "sha256").agg(F.max("new").alias("is_now"), F.min("new").alias("is_new"))
        gone = both.groupBy("path").agg(F.max("is_now").alias("is_now"), F.max(F.when(F.col("is_now") == 1, F.col("is_new"))).alias("scan"))
        row = gone.agg(F.count_if(F.expr("is_now = 1")).alias("n_files"), F.count_if(F.expr("is_now = 1 and scan = 1")).alias("n_scanned"),
                       F.count_if(F.expr("is_now = 1 and scan = 0")).alias("n_kept"), F.count_if(F.expr("is_now = 0")).alias("n_removed"))
        row.select(F.lit(n).alias("version"), *row.columns).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v{n}")
        return self.state(n)[1]


def distinct_content(stream: DataFrame, within: str, time_column: str = "arrived") -> DataFrame:
    """The first row of each content of a stream with an event time: the sha256
    is state, dropped ``within`` (an interval) after the newest time, so content
    that comes again later than that is a new row.  The state holds a key per
    content of that span, spread over the shuffle partitions by its hash."""
    keyed = stream.withColumn("sha256", F.sha2(F.coalesce(F.col("content"), F.lit("")), 256))
    return keyed.withWatermark(time_column, within).dropDuplicatesWithinWatermark(["sha256"])


def scan_stream(spark: SparkSession, source_dir: str, detect: Detector, out_dir: str,
                checkpoint_dir: str, schema: str = "path string, content string",
                source_format: str = "parquet", max_files_per_trigger: int | None = None,
                available_now: bool = True, distinct_within: str | None = None):
    """Stream files (rows ``path, content``) from ``source_dir`` through
    ``detect`` into ``out_dir``; returns the started query.  With
    ``distinct_within`` the schema needs a timestamp ``arrived``, and of rows of
    one content within that interval the first is scanned (``distinct_content``)."""
    reader = spark.readStream.format(source_format).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_dir)
    if distinct_within:
        stream = distinct_content(stream, distinct_within)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        detect(batch.select("path", "content")).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def scan_text_stream(spark: SparkSession, source_dir: str, detect: Detector, out_dir: str,
                     checkpoint_dir: str, available_now: bool = True):
    """I2 on raw files: each arriving file is one row, decoded as in the
    corpus scan (UTF-8, else CP949, else empty)."""
    use_cp949(spark)
    stream = (spark.readStream.format("binaryFile").schema(BINARY_FILES).load(source_dir)
              .select(F.col("_metadata.file_path").alias("path"), decode_text(F.col("content")).alias("content")))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        detect(batch).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
