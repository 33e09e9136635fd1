"""J11 at catalogue size: a literal-factor index instead of one expression per
pattern.

Every pattern is posted under a few q-grams of which each match must contain
one (``functions.factors``).  The q-grams of a text that are keys of the index
are found in the tasks by array lookups; only the (text, pattern) pairs they
lead to reach a regex.  So the corpus is read once whatever the number of
patterns, and the regex work grows with the candidates instead of texts x
patterns.  Keys are as long as the literals allow, so that a key leads to few
patterns however large the catalogue is.  Patterns without a literal of ``Q``
characters are posted under the empty key, which every text has.

A catalogue within ``INDEX_BYTES`` is analysed in the driver, its keys, of 8
bytes each, and its postings are broadcast (``candidates``).  A larger one never
comes together in the driver (``candidates_of``): it is a table, analysed and
posted in the tasks; they get a filter of the keys of at most ``FILTER_BYTES``,
and the texts that hold what may be a key are joined with the postings by a
shuffle.  The corpus is read once in either case.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.factors import LENGTHS, exact_literal, grams, index_keys, required_clauses
from ..session import materialize

INDEX_BYTES = 16 << 20  # of patterns in one broadcast index
FILTER_BYTES = 64 << 20  # of the filter of the keys of a larger index
FILTER_BITS = 32  # a key, up to that size: some 0.1 % of what is no key passes
BLOCK = 4096  # words of a filter in one row
CHUNK = 1 << 18  # places of texts looked up at a time
_ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
_LOWER = np.frombuffer(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)), np.uint8)


def code_of(key: str) -> int:
    """A key as a number: its bytes, the first the lowest; the empty key is 0."""
    return int.from_bytes(key.encode(), "little")


_MIX = np.uint64(0x9E3779B97F4A7C15)


class Keys:
    """Lookup of the keys of an index in texts."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.has_empty = len(self.keys) > 0 and self.keys[0] == 0
        self.bits = min(24, max(10, int(8 * len(self.keys)).bit_length()))
        self.marked = np.zeros(1 << self.bits, bool)
        self.marked[self._slot(self.keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MIX) >> np.uint64(64 - self.bits)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Where ``codes`` are keys."""
        at = np.flatnonzero(self.marked[self._slot(codes)])
        code = codes[at]
        place = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
        return at[self.keys[place] == code]

    def find(self, texts: pa.Array) -> pa.Array:
        """For each text its distinct keys, ascending; every text but null has the empty key."""
        texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        size = int(ends[-1] - ends[0])
        data = np.zeros(size + 8, np.uint8)
        if size:
            data[:size] = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8, size, int(ends[0]))]
        ends = ends - ends[0]
        rows, keys = [], []
        if self.has_empty:
            rows.append(np.flatnonzero(np.asarray(texts.is_valid())))
            keys.append(np.zeros(len(rows[0]), np.uint64))
        for begin in range(0, size, CHUNK):
            n = min(CHUNK, size - begin)
            eight = np.ndarray((n,), "<u8", data, begin, (1,)).astype(np.uint64)
            for q in LENGTHS:
                code = eight & np.uint64((1 << 8 * q) - 1)
                at = self.places(code)
                code = code[at]
                # a key of this length, in one text
                at, code = at[keep := code >> np.uint64(8 * q - 8) > 0] + begin, code[keep]
                row = np.searchsorted(ends, at, side="right") - 1
                keep = at + q <= ends[row + 1]
                rows.append(row[keep])
                keys.append(code[keep])
        rows, keys = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, keys))
        order = np.lexsort((keys, rows))
        rows, keys = rows[order], keys[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
        rows, keys = rows[new], keys[new]
        starts = np.searchsorted(rows, np.arange(len(texts) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(keys.astype(np.int64)))


class KeyFilter(Keys):
    """The same with few others among the keys: a Bloom filter whose bits of a
    key lie in one word."""

    has_empty = False

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def slots(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """The word of each key and its bits there."""
        h = keys * _MIX
        h ^= h >> np.uint64(32)
        h *= _MIX
        bits = np.uint64(1) << (h & np.uint64(63))
        for shift in (6, 12, 18):
            bits |= np.uint64(1) << (h >> np.uint64(shift) & np.uint64(63))
        return (h >> np.uint64(32)) & np.uint64(words - 1), bits

    def places(self, codes: np.ndarray) -> np.ndarray:
        word, bits = self.slots(codes, len(self.words))
        return np.flatnonzero(self.words[word] & bits == bits)


def with_keys(texts: DataFrame, text: str, keys: np.ndarray, lookup_of=Keys) -> DataFrame:
    """The ``texts`` that hold a key of the index, with all of them as ``_found``."""
    sent = texts.sparkSession.sparkContext.broadcast(keys)
    place = texts.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = None
        for batch in batches:
            lookup = lookup or lookup_of(sent.value)
            found = lookup.find(batch.column(place))
            out = pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "_found"])
            yield out.filter(pc.greater(pc.list_value_length(found), 0))

    schema = ", ".join(f"`{n}` {t}" for n, t in texts.dtypes) + ", _found array<bigint>"
    return texts.mapInArrow(run, schema)


def _size(row: tuple) -> int:
    return 64 + sum(len(str(x)) for x in row)


def parts(rows: list[tuple], size=_size, bound: int | None = None) -> list[list[tuple]]:
    """``rows`` in runs of at most ``bound`` (``INDEX_BYTES``) bytes."""
    out, used = [[]], 0
    for r in rows:
        if out[-1] and used + size(r) > (bound or INDEX_BYTES):
            out.append([])
            used = 0
        out[-1].append(r)
        used += size(r)
    return out


def _posted(spark, rows: list[tuple], factors: list, schema: str) -> DataFrame:
    """A row per pattern and key: ``_key``, ``_keys``, ``_literal`` and the
    fields of the catalogue row, each behind ``_p_``."""
    each = [(code_of(key), r, f) for r, f in zip(rows, factors) for key in (f.keys or ("",))]
    columns = {"_key": pa.array([k for k, _, _ in each], pa.int64()),
               "_keys": pa.array([[code_of(k) for k in f.keys] for _, _, f in each], pa.list_(pa.int64())),
               "_literal": pa.array([f.literal for _, _, f in each], pa.string())}
    for i, field in enumerate(schema.split(", ")):
        name, kind = field.split(": ")
        columns[f"_p_{name}"] = pa.array([r[i] for _, r, _ in each], _ARROW[kind])
    return spark.createDataFrame(pa.table(columns))


def _pairs(found: DataFrame, posted: DataFrame, text: str) -> DataFrame:
    """Texts with ``_found`` joined with what is posted under a key of theirs."""
    pairs = found.withColumn("_key", F.explode("_found")).join(posted, "_key")
    # a pattern with several keys in the text is taken at the first of them
    first = F.filter(F.col("_keys"), lambda k: F.array_contains("_found", k))[0]
    pairs = pairs.where((F.size("_keys") <= 1) | (F.col("_key") == first))
    return pairs.where(F.contains(F.col(text), F.col("_literal")))


def candidates(texts: DataFrame, text: str, rows: list[tuple], schema: str, ignore_case: bool = False) -> DataFrame:
    """(columns of ``texts``, those of a catalogue row) for the pairs that may
    match.  The last field of ``rows`` / ``schema`` is the pattern."""
    factors = index_keys([r[-1] for r in rows], ignore_case)
    keys = np.unique(np.array([code_of(k) for f in factors for k in (f.keys or ("",))], np.uint64))
    posted = _posted(texts.sparkSession, rows, factors, schema)
    names = [c.split(":")[0].strip() for c in schema.split(", ")]
    return _pairs(with_keys(texts, text, keys), F.broadcast(posted), text).select(
        *texts.columns, *[F.col(f"_p_{n}").alias(n) for n in names])


def _gram_batches(place: int, ignore_case: bool):
    """Adds ``_literal`` and ``_grams``, the numbers of a clause and of a literal of
    it with a q-gram, to patterns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            literals, ends, c, n, k = [], [0], [], [], []
            for pattern in batch.column(place).to_pylist():
                clauses = required_clauses(pattern, ignore_case)
                literals.append(exact_literal(pattern, clauses, ignore_case))
                for i, clause in enumerate(clauses):
                    for j, literal in enumerate(clause):
                        codes = [code_of(g) for g in grams(literal)]
                        c += [i] * len(codes)
                        n += [j] * len(codes)
                        k += codes
                ends.append(len(k))
            found = pa.StructArray.from_arrays([pa.array(c, pa.int32()), pa.array(n, pa.int32()), pa.array(k, pa.int64())], ["c", "n", "k"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(literals, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)],
                                             [*batch.schema.names, "_literal", "_grams"])
    return run


def rarest_keys(table: DataFrame) -> DataFrame:
    """``_id, _keys``: the choice of ``index_keys`` for the patterns of a table
    ``_id, _grams`` that have a clause."""
    users = table.select(F.explode(F.array_distinct("_grams.k")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("users"))
    each = table.select("_id", F.explode("_grams").alias("g")).select("_id", "g.c", "g.n", "g.k").join(users, "k")
    rarest = each.repartition("_id").groupBy("_id", "c", "n").agg(F.min(F.struct("users", "k")).alias("g"))
    clauses = rarest.groupBy("_id", "c").agg(F.collect_set("g").alias("g"))
    choice = F.struct(F.aggregate("g", F.lit(0).cast("bigint"), lambda a, x: a + x["users"]).alias("users"), F.size("g").alias("size"),
                      F.array_sort(F.transform("g", lambda x: x["k"])).alias("keys"))
    return clauses.groupBy("_id").agg(F.min(choice)["keys"].alias("_keys"))


def filter_words(keys: DataFrame, count: int) -> np.ndarray:
    """The words of a ``KeyFilter`` of a table of ``count`` keys, made in the tasks."""
    words = min(FILTER_BYTES // 8, max(BLOCK, 1 << (count * FILTER_BITS // 64).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bits = KeyFilter.slots(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64), words)
            word = word.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((word // BLOCK).astype(np.int32)), pa.array((word % BLOCK).astype(np.int32)),
                                              pa.array(bits.view(np.int64))], ["block", "word", "bits"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            block, word, bits = (c.to_numpy() for c in batch.columns)
            order = np.argsort(block, kind="stable")
            numbers, begins = np.unique(block[order], return_index=True)
            for number, part in zip(numbers.tolist(), np.split(order, begins[1:])):
                np.bitwise_or.at(held.setdefault(number, np.zeros(BLOCK, np.uint64)), word[part], bits[part].view(np.uint64))
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(held), pa.int32()), "words": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    made = keys.mapInArrow(slots, "block int, word int, bits bigint").repartition("block").mapInArrow(blocks, "block int, words binary")
    out = np.zeros(words, np.uint64)
    for r in made.collect():
        out[r.block * BLOCK:(r.block + 1) * BLOCK] = np.frombuffer(r.words, np.uint64)
    return out


def candidates_of(texts: DataFrame, text: str, patterns: DataFrame, ignore_case: bool = False) -> DataFrame:
    """``candidates`` for a catalogue in a table (with a column ``pattern``) of
    any size, which is neither collected nor broadcast."""
    names = patterns.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in patterns.dtypes) + ", _literal string, _grams array<struct<c:int,n:int,k:bigint>>"
    analysed = patterns.mapInArrow(_gram_batches(names.index("pattern"), ignore_case), schema)
    table = materialize(analysed.withColumn("_id", F.monotonically_increasing_id()), "catalogue")
    row = [F.col(n).alias(f"_p_{n}") for n in names]
    chosen = materialize(rarest_keys(table), "keys")
    count = chosen.agg(F.sum(F.size("_keys"))).first()[0] or 0
    out = []
    if count:
        posted = table.select("_id", "_literal", *row).join(chosen, "_id").withColumn("_key", F.explode("_keys")).drop("_id")
        words = filter_words(chosen.select(F.explode("_keys").alias("key")), count)
        out.append(_pairs(with_keys(texts, text, words, KeyFilter), posted, text))
    # patterns without a key meet every text, as many of them at a time as may be broadcast
    bare = table.where(F.size("_grams") == 0)
    size = bare.agg(F.sum(table_size(bare, names))).first()[0] or 0
    n = -(-size // INDEX_BYTES)
    for i in range(n):
        out.append(texts.where(F.col(text).isNotNull()).crossJoin(F.broadcast(bare.where(F.col("_id") % n == i).select(*row))))
    picked = [x.select(*texts.columns, *[F.col(f"_p_{n}").alias(n) for n in names]) for x in out]
    return union_of(picked) if picked else texts.limit(0).crossJoin(patterns.limit(0))


def table_size(table: DataFrame, names: list[str] | None = None) -> Column:
    """``_size`` of the rows of a table."""
    text = [F.coalesce(F.octet_length(F.col(n).cast("string")), F.lit(0)) for n in names or table.columns]
    return sum(text, F.lit(64))


def union_of(parts_of: list[DataFrame]) -> DataFrame:
    out = parts_of[0]
    for df in parts_of[1:]:
        out = out.unionByName(df)
    return out
