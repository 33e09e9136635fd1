"""Corpus sources.

``scan_corpus`` reads a directory tree with Spark's ``binaryFile`` source —
one row per file, read by the executors, never by the driver.  Size, suffix
and exclude filters are predicates on the file's metadata (``_metadata``),
which Spark applies to the file listing, so skipped files are never opened.
Where only the hash of a file is asked for, a large one is read as a stream.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from typing import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog as CAT

DEFAULT_MAX_BYTES = 104_857_600  # 100 MiB, the reference's default
STREAMED_BYTES = 32 << 20  # files beyond, of which only the hash is asked for, never stand in memory as a whole
WHOLE = 1 << 45  # bytes of a split that holds any one file
# Spark's text reader unpacks files with these names, so their own bytes come from ``binaryFile`` alone.
PACKED = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst", ".passthrough")
_MARK = b"\xef\xbb\xbf"  # the byte order mark, which the text reader takes off a file


def decode_text(content: Column) -> Column:
    """UTF-8, else CP949 (EUC-KR is a subset), else empty — as upstream.

    CP949 validity is tested by a lossless round trip (the JVM decoder
    substitutes rather than fails).  Text-mode newline translation
    (``\\r\\n`` and lone ``\\r`` -> ``\\n``) is applied after decoding.
    Needs ``use_cp949``.
    """
    cp = F.decode(content, "x-windows-949")
    cp_ok = F.encode(cp, "x-windows-949") == content
    text = (F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8"))
            .when(cp_ok, cp).otherwise(F.lit("")))
    return F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")


def use_cp949(spark: SparkSession) -> None:
    """Enable what ``decode_text`` needs: the JVM's extended charsets, and that
    a byte sequence which is none of a charset is replaced instead of ending
    the job (it then fails the round trip)."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")


def scan_corpus(spark: SparkSession, root: str, max_bytes: int | None = DEFAULT_MAX_BYTES,
                exclude: Sequence[str] = (), exclude_mode: str = "basename", glob: str | None = None,
                decode: bool = True, suffixes: Sequence[str] = (), content: bool = True) -> DataFrame:
    """``path, repo, ext, size, sha256, content`` for every file under ``root``.

    ``path`` is relative to ``root``; ``repo`` is the root's name.  With
    ``suffixes``, only files whose path ends in one of them; ``max_bytes``
    None keeps files of any size.  Without ``content`` that column is left out,
    and a file may be larger than the 2 GiB that a row holds.
    """
    if decode and content:
        use_cp949(spark)

    def reader_of(session, kind):
        reader = session.read.format(kind).option("recursiveFileLookup", "true")
        return reader.option("pathGlobFilter", glob) if glob else reader

    base = root.rstrip("/")
    # compare URI paths without scheme and authority (file:, hdfs://host, s3a://bucket)
    uri = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    base_path = re.sub(uri, "", base).lstrip("/")

    def relative(path):
        return F.regexp_replace(F.regexp_replace(path, uri, ""), r"^/*" + re.escape(base_path) + "/?", "")

    def decoded(uri_path):
        return relative(F.url_decode(F.regexp_replace(uri_path, r"\+", "%2B")))

    listed = decoded(F.col("_metadata.file_path"))  # the metadata's path is URI-encoded

    def wanted(raw):
        if max_bytes is not None:
            raw = raw.where(F.col("_metadata.file_size") <= F.lit(max_bytes))
        if suffixes:
            ends = [listed.endswith(s) for s in suffixes]
            raw = raw.where(reduce(lambda a, b: a | b, ends))
        return exclude_globs(raw, exclude, exclude_mode, path=listed) if exclude else raw

    raw = wanted(reader_of(spark, "binaryFile").load(root))
    packed = reduce(lambda a, b: a | b, [F.col("_metadata.file_name").endswith(s) for s in PACKED])
    streamed = (F.col("_metadata.file_size") > F.lit(STREAMED_BYTES)) & ~packed
    if not content:
        raw = raw.where(~streamed)
    meta = raw.select(relative(F.col("path")).alias("path"), F.col("length").alias("size"),
                      F.sha2(F.col("content"), 256).alias("sha256"), "content")
    if not content:
        large = wanted(reader_of(_whole_files(spark), "text").option("lineSep", "\n").load(root)).where(streamed)
        large = large.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))
        hashed = large.mapInArrow(_stream_hashes, "path string, size bigint, sha256 string")
        meta = meta.drop("content").unionByName(hashed.withColumn("path", decoded(F.col("path"))))
    columns = [F.col("path"), F.lit(base.rsplit("/", 1)[-1]).alias("repo"),
               F.regexp_extract("path", r"(\.[^./]*)$", 1).alias("ext"), F.col("size"), F.col("sha256")]
    if content:
        columns.append((decode_text(F.col("content")) if decode else F.col("content")).alias("content"))
    return meta.select(*columns)


def _whole_files(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` in which no file is split and no
    two share a task, so that a task reads a file from its first byte to its last."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if session.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.files.maxPartitionBytes", str(WHOLE))
    session.conf.set("spark.sql.files.openCostInBytes", str(WHOLE))
    return session


def _stream_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, size, sha256`` of files from ``path, size, line``, the raw lines of
    each file in order.  The size tells whether a line end closes the file and
    whether a byte order mark was taken off it."""
    path = size = None
    plain = marked = seen = None

    def result():
        for digest, missing in ((plain, size - seen), (marked, size - seen - len(_MARK))):
            if missing in (0, 1):
                digest.update(b"\n" * missing)
                return pa.RecordBatch.from_pydict({"path": pa.array([path]), "size": pa.array([size], pa.int64()),
                                                   "sha256": pa.array([digest.hexdigest()])})
        raise ValueError(f"{path}: {seen} bytes were read of {size}")

    for batch in batches:
        begin = 0
        # the files of a batch, in runs of lines
        for run in pc.run_end_encode(batch.column(0)).run_ends.to_pylist():
            lines = pa.ListArray.from_arrays(pa.array([0, run - begin], pa.int32()), batch.column(2).slice(begin, run - begin))
            piece = pc.binary_join(lines, b"\n")[0].as_buffer()
            if (new := batch.column(0)[begin].as_py()) != path:
                if path is not None:
                    yield result()
                path, size, seen = new, batch.column(1)[begin].as_py(), 0
                plain, marked = hashlib.sha256(), hashlib.sha256(_MARK)
            else:
                plain.update(b"\n")
                marked.update(b"\n")
                seen += 1
            plain.update(piece)
            marked.update(piece)
            seen += len(piece)
            begin = run
    if path is not None:
        yield result()


def limit_size(files: DataFrame, max_bytes: int) -> DataFrame:
    """Drop files larger than ``max_bytes``."""
    col = "size" if "size" in files.columns else "length"
    return files.where(F.col(col) <= F.lit(max_bytes))


def resolve_language(files: DataFrame, lowercase: bool = True) -> DataFrame:
    """Ext -> language through a 13-row literal table (broadcast)."""
    ext = F.regexp_extract(F.col("path"), r"(\.[^./]*)$", 1)
    if lowercase:
        ext = F.lower(ext)
    table = CAT.extension_languages(files.sparkSession).withColumnRenamed("ext", "_ext")
    return (files.withColumn("_ext", ext).join(F.broadcast(table), "_ext", "left")
            .withColumnRenamed("_ext", "ext"))


# --- S3: exclude globs ---------------------------------------------------------------

def _glob_segment(seg: str, negate: str) -> str:
    """One path segment of a glob as a regex (no ``/`` crossing)."""
    out, i = [], 0
    while i < len(seg):
        ch = seg[i]
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[":
            j = seg.find("]", i + 1)
            if j == -1:
                out.append(re.escape(ch))
            else:
                body = seg[i + 1:j]
                if body.startswith(negate):
                    body = "^" + body[1:]
                out.append("[" + body.replace("\\", "\\\\") + "]")
                i = j
        elif ch == "\\" and negate == "^" and i + 1 < len(seg):
            i += 1
            out.append(re.escape(seg[i]))
        else:
            out.append(re.escape(ch))
        i += 1
    return "".join(out)


def glob_regex(pattern: str, mode: str = "basename", recursive: bool = False) -> str:
    """Regex for one exclude pattern.

    ``basename`` (Go scanner, ``filepath.Match``): whole-name match of one
    path segment, ``[^..]`` negation.  ``path`` (Python CLI,
    ``PurePath.match``): right-anchored match of the last segments, ``[!..]``
    negation, ``**`` matching exactly one segment like ``*``.
    """
    if mode == "basename":
        return "^" + _glob_segment(pattern, "^") + "$"
    absolute = pattern.startswith("/")
    segs = [s for s in pattern.strip("/").split("/") if s]
    if recursive:
        # ``**`` spans any number of segments (including none)
        body = ""
        for k, seg in enumerate(segs):
            last = k == len(segs) - 1
            if seg == "**":
                body += ".*" if last else "(?:[^/]+/)*"
            else:
                body += _glob_segment(seg, "!") + ("" if last else "/")
    else:
        body = "/".join(_glob_segment(s, "!") for s in segs)
    return ("^/?" if absolute else "(^|/)") + body + "$"


def exclude_globs(files: DataFrame, globs: Sequence[str], mode: str = "basename",
                  recursive: bool = False, path: Column | None = None) -> DataFrame:
    """S3: drop files matched by any exclude glob.

    ``basename``: a glob matching the file name or any directory name on the
    path (which prunes that subtree in the Go walk).  ``path``: a glob
    matching the right end of the path.  ``path`` is the column ``path``
    unless given.
    """
    path = F.col("path") if path is None else path
    globs = [g.strip() for g in globs if g and g.strip()]
    if not globs:
        return files
    if mode == "basename":
        segs = F.split(path, "/")
        hit = F.lit(False)
        for g in globs:
            rx = glob_regex(g, "basename")
            hit = hit | F.exists(segs, lambda s: s.rlike(rx))
    else:
        hit = F.lit(False)
        for g in globs:
            hit = hit | path.rlike(glob_regex(g, "path", recursive))
    return files.where(~hit)


# --- S5 ------------------------------------------------------------------------------

def to_lines(files: DataFrame) -> DataFrame:
    """1-based numbered lines (Go's reader drops a trailing ``\\r``)."""
    return files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "text")).select(
        "path", (F.col("pos") + 1).cast("int").alias("line_no"),
        F.regexp_replace("text", r"\r$", "").alias("text"))


# --- S10 -----------------------------------------------------------------------------

def inline_batch(rows: DataFrame, languages: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(code, language, fileName?)`` rows -> (accepted files, rejects).

    Default file name ``code.<language>``; rows whose language no registered
    detector supports go to the rejects table with the reason.
    """
    spark = rows.sparkSession
    if languages is None:
        languages = [lang for d in CAT.DETECTOR_LANGUAGES.values() for lang in d]
    supported = F.broadcast(spark.createDataFrame([(lang,) for lang in languages], "language string"))
    named = rows.withColumn("fileName", F.coalesce(
        F.when(F.col("fileName") != "", F.col("fileName")), F.concat(F.lit("code."), F.col("language"))))
    ok = named.join(supported, "language", "left_semi").select(
        F.col("fileName").alias("path"), "language", F.col("code").alias("content"))
    bad = named.join(supported, "language", "left_anti").select(
        F.col("fileName").alias("path"), "language",
        F.concat(F.lit("Unsupported language: "), F.col("language")).alias("error"))
    return ok, bad
