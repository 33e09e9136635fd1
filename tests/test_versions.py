"""Versioned incremental state and content de-duplication of streams."""

from pyspark.sql import functions as F

from codesift.streaming import scan as STR


def hashed(spark, rows):
    return spark.createDataFrame(rows, "path string, content string").withColumn("sha256", F.sha2("content", 256)).select("path", "sha256", "content")


def test_versions_scan_only_changes_and_survive_a_broken_update(spark, tmp_path):
    scanned = []

    def detect(files):
        scanned.append(sorted(r.path for r in files.collect()))
        return files.select("path", F.length("content").alias("n"))

    def broken(files):
        return files.select("path", F.raise_error(F.lit("lost")).cast("int").alias("n"))

    scan = STR.IncrementalScan(spark, f"{tmp_path}/state", "path string, n int")
    results = lambda: sorted((r.path, r.n) for r in scan.state()[1].collect())
    assert scan.version() == 0 and results() == []
    scan.update(hashed(spark, [("a", "1"), ("b", "22"), ("c", "333")]), detect)
    second = hashed(spark, [("a", "1"), ("b", "4444"), ("d", "")])
    try:
        scan.update(second, broken)
    except Exception:
        pass
    assert scan.version() == 1 and results() == [("a", 1), ("b", 2), ("c", 3)]
    scan.update(second, detect)
    assert scanned == [["a", "b", "c"], ["b", "d"]] and results() == [("a", 1), ("b", 4), ("d", 0)]
    rows = [tuple(r) for r in scan.manifest().orderBy("version").collect()]
    assert rows == [(1, 3, 3, 0, 0), (2, 3, 2, 1, 1)]
    assert sorted((r.path, r.n) for r in scan.state(1)[1].collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_stream_scans_content_once_until_the_watermark_passes(spark, tmp_path):
    src, out, ckpt = (f"{tmp_path}/{x}" for x in ("src", "out", "ckpt"))

    def send(minute, *contents):
        rows = [(f"p{minute}-{k}", c) for k, c in enumerate(contents)]
        spark.createDataFrame(rows, "path string, content string").withColumn(
            "arrived", F.expr(f"timestamp'2024-01-01 00:00:00' + interval {minute} minutes")).coalesce(1).write.mode("append").parquet(src)
        STR.scan_stream(spark, src, lambda b: b, out, ckpt, schema="path string, content string, arrived timestamp",
                        distinct_within="10 minutes").awaitTermination()
        return sorted((r.path, r.content) for r in spark.read.schema("path string, content string").parquet(out).collect())

    assert len(send(0, "x", "y", "x", None)) == 3
    assert [c for _, c in send(1, "x", "z", "")].count("x") == 1            # null and empty content are the same
    assert len(spark.read.parquet(out).collect()) == 4
    send(60, "w")
    assert [c for _, c in send(61, "x", "w")].count("x") == 2               # long after: new again
