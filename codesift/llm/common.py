"""Helpers shared by the document operators: Arrow batch iteration, word
hashing with numpy, and written intermediate tables."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.session import ensure_checkpoint_dir

# Bytes of text handled at once inside a task (longer texts come alone).
CHUNK_BYTES = 1 << 20
# Distinct words kept in a per-task cache before it is emptied.
CACHE_WORDS = 200_000
# Bits of a bitmap of keys (4 MiB).
MARKS = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: the lineage
    ends there, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def marked(keys: DataFrame, column: str):
    """A test of a column that holds for every value of ``keys[column]`` and few
    others, by a bitmap of ``MARKS`` bits whatever the number of keys."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS))
    words = keys.select(place(F.col(column)).alias("at")).groupBy(F.shiftright("at", 6).alias("word")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(MARKS // 64, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()

    @F.arrow_udf("boolean")
    def test(at: pa.Array) -> pa.Array:
        at = at.to_numpy(zero_copy_only=False)
        return pa.array((bitmap[at >> 6] >> (at & 63)) & 1 == 1)

    return lambda c: test(place(F.col(c)))


def columns(df: DataFrame, **wanted) -> DataFrame:
    """Only the named columns under fixed names, so that further columns of
    ``df`` (also such with clashing names) never reach an operator's joins."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in wanted.items()])


def texts_of(column) -> list:
    """UTF-8 bytes (or None) of an Arrow string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def text_slices(column, limit: int = CHUNK_BYTES):
    """(first row, texts) for runs of rows with about ``limit`` bytes of text."""
    size = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(size)
    a, n = 0, len(size)
    while a < n:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + limit, side="right")))
        yield a, texts_of(column.slice(a, b - a))
        a = b


def batches(it, text: str = "text", limit: int = CHUNK_BYTES):
    """(record batch slice, its texts) of about ``limit`` bytes each."""
    for batch in it:
        for a, texts in text_slices(batch.column(text), limit):
            yield batch.slice(a, len(texts)), texts


def tidy(task):
    """``task`` (a function of an Arrow batch iterator) that hands freed memory
    back to the system at its end: Python workers are reused, and two of them
    share an executor's memory with its JVM."""
    def run(it):
        try:
            yield from task(it)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)
    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(29))


class WordHasher:
    """64-bit hashes of byte words, with a bounded cache."""

    def __init__(self):
        self.cache: dict[bytes, int] = {}

    def __call__(self, words: list) -> np.ndarray:
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        for w in set(words).difference(self.cache):
            self.cache[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))


def shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles; fewer words than k are one shingle."""
    n = len(word_hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(k, n)
    acc = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        acc = acc * np.uint64(0x9FB21C651E98DF25) + word_hashes[j:n - width + 1 + j]
    return mix(acc)


def flat_shingles(word_hashes: np.ndarray, lens: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingles`` for many texts laid out one after the other, each of at
    least one word (``lens``), and where each text's shingles start; repeated
    shingles are kept."""
    counts = np.maximum(lens - k + 1, 1)
    starts = np.cumsum(counts) - counts
    out = np.empty(counts.sum(), np.uint64)
    n = len(word_hashes) - k + 1
    if n > 0:
        acc = np.full(n, k, np.uint64)
        for j in range(k):
            acc = acc * np.uint64(0x9FB21C651E98DF25) + word_hashes[j:n + j]
        of = np.repeat(np.arange(len(lens)), lens)
        out[np.repeat(lens >= k, counts)] = mix(acc[of[:n] == of[k - 1:]])
    begins = np.cumsum(lens) - lens
    for width in range(1, k):
        short = np.flatnonzero(lens == width)
        acc = np.full(len(short), width, np.uint64)
        for j in range(width):
            acc = acc * np.uint64(0x9FB21C651E98DF25) + word_hashes[begins[short] + j]
        out[starts[short]] = mix(acc)
    return out, starts


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)
