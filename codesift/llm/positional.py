"""Benchmark decontamination with a distributed positional inverted index.

The index is sharded by documents: a segment covers a run of documents and
stores, per term, the sorted positions at which it occurs.  Segments are rows
of a Parquet table.  A phrase is looked up in a segment by taking the postings
of its rarest term there, shifted by the term's offset in the phrase, and
intersecting them with the shifted postings of the next rarest terms until
only exact matches remain; a proximity match intersects within a slop: every
term lies at most so many words from the place it has in the phrase, counted
from an occurrence of the rarest term, and all in one document.

Defined results: null or empty texts have no words and are never hit; items
without words match nothing; repeated rows are indexed one by one; empty
tables give no hits; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, columns, tidy, written

# Lower-cases A-Z, keeps 0-9, a-z and all bytes of non-ASCII characters; every
# other byte separates words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))
# Words of a segment (a longer document is a segment by itself).
SEGMENT_WORDS = 150_000
# Bytes of phrases that one pass over the index carries to every task.
PASS_BYTES = 8 << 20
WINDOW = 10

SEGMENT = ("segment string, doc_ids array<bigint>, n_words array<int>, terms array<binary>, ends array<int>, positions array<int>")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Index table, one row per segment.

    ``terms`` are sorted; the positions of term i are
    ``positions[ends[i-1]:ends[i]]``, ascending word numbers in the segment,
    where documents follow each other in the order of ``doc_ids``, each
    followed by one unused position.
    """
    def segments(it):
        ids, counts, words = [], [], []
        made = 0

        def segment():
            terms = sorted(set(words))
            number = dict(zip(terms, range(len(terms))))
            # numbers of 16 bits are sorted by radix
            code = np.fromiter(map(number.__getitem__, words), np.uint16 if len(terms) <= 1 << 16 else np.int32, len(words))
            n = np.array(counts, np.int32)
            place = np.arange(len(words), dtype=np.int32) + np.repeat(np.arange(len(n), dtype=np.int32), n)
            by_term = np.argsort(code, kind="stable")
            ends = np.cumsum(np.bincount(code, minlength=len(terms))).astype(np.int32)
            one = lambda v, t: pa.array([v], pa.list_(t))
            name = pa.array([f"{TaskContext.get().partitionId()}-{made}"])
            return pa.record_batch([name, one(ids, pa.int64()), one(n, pa.int32()), one(terms, pa.binary()),
                                    one(ends, pa.int32()), one(place[by_term], pa.int32())],
                                   ["segment", "doc_ids", "n_words", "terms", "ends", "positions"])

        for batch, texts in batches(it):
            for doc, t in zip(batch.column("doc_id").to_pylist(), texts):
                mine = words_of(t)
                if ids and len(words) + len(mine) > segment_words:
                    yield segment()
                    made += 1
                    ids, counts, words = [], [], []
                ids.append(doc)
                counts.append(len(mine))
                words += mine
        if ids:
            yield segment()

    d = columns(docs, doc_id=doc_id, text=text)
    return written(d.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidy(segments), SEGMENT), "index")


class Segment:
    """Lookup of phrases in one segment."""

    def __init__(self, terms, ends, positions):
        self.number = {t: i for i, t in enumerate(terms)}
        self.ends = np.r_[0, ends].astype(np.int64)
        # postings of all terms as one sorted array: term number, then position
        lens = np.diff(self.ends)
        self.span = (int(positions.max()) if len(positions) else 0) + 2
        self.positions = positions.astype(np.int64)
        self.key = self.positions + np.repeat(np.arange(len(lens), dtype=np.int64), lens) * self.span
        self.lens = lens

    def phrases(self, flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, slop: int = 0,
                docs: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every match.  ``flat`` holds the phrases'
        term numbers here (-1: no such term), ``starts``/``lens`` each phrase's
        part.  With ``slop`` every term may lie up to so many words away from
        its place, but in the same document (``docs``: where each begins, and
        its number of words); the position is that of the phrase's first word, or
        the document's beginning if that is later."""
        absent = np.minimum.reduceat(flat, starts) < 0 if len(starts) else np.empty(0, bool)
        alive = np.flatnonzero(~absent)
        if not len(alive):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        width = int(lens[alive].max())
        # terms of each phrase from the rarest on
        offs = np.arange(width)
        inside = offs[None, :] < lens[alive][:, None]
        term = np.where(inside, flat[np.minimum(starts[alive][:, None] + offs, len(flat) - 1)], 0)
        count = np.where(inside, self.lens[term], np.iinfo(np.int64).max)
        order = np.argsort(count, axis=1, kind="stable")
        rows = np.arange(len(alive))
        rare = term[rows, order[:, 0]]
        n = self.lens[rare]
        phrase = np.repeat(rows, n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        anchor = self.positions[self.ends[rare][phrase] + within]
        place = anchor - order[phrase, 0]
        first, last = np.zeros(len(place), np.int64), np.full(len(place), self.span)
        if slop and docs is not None:
            doc = np.searchsorted(docs[0], anchor, side="right") - 1
            first, last = docs[0][doc], docs[0][doc] + docs[1][doc] - 1
        keep = place >= (first - slop if slop else 0)
        phrase, place, first, last = phrase[keep], place[keep], first[keep], last[keep]
        for j in range(1, width):
            if not len(phrase):
                break
            off = order[phrase, j]
            active = j < lens[alive][phrase]
            t = term[phrase, off]
            want = place + off
            low = np.maximum(want - slop, first)
            at = np.searchsorted(self.key, t * self.span + low)
            found = self.key[np.minimum(at, len(self.key) - 1)]
            ok = (at < len(self.key)) & (found // self.span == t) & (found % self.span <= np.minimum(want + slop, last))
            keep = ok | ~active
            phrase, place, first, last = phrase[keep], place[keep], first[keep], last[keep]
        return alive[phrase], np.maximum(place, first)


class Phrases:
    """A block of phrases (lists of words), ready for lookup in any segment."""

    def __init__(self, phrases: list[list[bytes]]):
        seen: dict[bytes, int] = {}
        flat = [seen.setdefault(w, len(seen)) for p in phrases for w in p]
        self.terms = list(seen)
        self.flat = np.array(flat, np.int64)
        self.lens = np.array([len(p) for p in phrases], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens

    def find(self, segment: Segment, slop: int = 0, docs=None):
        here = np.array([segment.number.get(t, -1) for t in self.terms], np.int64)
        return segment.phrases(here[self.flat], self.starts, self.lens, slop, docs)


def windows_of(words: list[bytes], n: int = WINDOW) -> list[tuple]:
    if not words:
        return []
    return [tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]


def passes(items: DataFrame, n: int, pass_bytes: int = PASS_BYTES):
    """Blocks of at most about ``pass_bytes`` of items, each as (distinct
    windows, for each the items that hold it).  The items are streamed to the
    driver block by block, never all at once."""
    size, windows = 0, {}
    for row in items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).toLocalIterator():
        words = words_of(bytes(row.t) if row.t is not None else None)
        size += sum(map(len, words)) + 1
        for w in windows_of(words, n):
            windows.setdefault(w, set()).add(row.i)
        if size >= pass_bytes:
            yield windows
            size, windows = 0, {}
    if windows:
        yield windows


HITS = "doc_id bigint, n_words bigint, spans array<struct<a:int,b:int>>, items array<string>, segment string, row bigint"


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", n: int = WINDOW,
           slop: int = 0) -> DataFrame:
    """For every indexed document: doc_id, n_words, ``spans`` (merged word
    ranges [a, b) covered by matches) and ``items`` (ids of matching items)."""
    spark = index.sparkSession
    its = columns(items, item_id=item_id, text=text)
    results = []
    for windows in passes(its, n):
        sent = spark.sparkContext.broadcast([(list(w), sorted(i for i in s if i is not None)) for w, s in windows.items()])
        results.append(index.mapInArrow(_finder(sent, slop), HITS))
    if not results:
        results = [index.mapInArrow(_finder(spark.sparkContext.broadcast([]), slop), HITS)]
    if len(results) == 1:
        return results[0].drop("segment", "row")
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    merged = every.groupBy("doc_id", "n_words", "segment", "row").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.select("doc_id", "n_words", merge_spans("spans").alias("spans"), "items")


def merged_ranges(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def merge_spans(column: str):
    @F.arrow_udf("array<struct<a:int,b:int>>")
    def merge(spans: pa.Array) -> pa.Array:
        rows = [[{"a": a, "b": b} for a, b in merged_ranges([(s["a"], s["b"]) for s in row])] for row in spans.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
    return merge(column)


def _finder(sent, slop):
    def find(it):
        block, owners = None, None
        for batch in it:
            if block is None:
                owners = [s for _, s in sent.value]
                block = Phrases([w for w, _ in sent.value])
            for r in range(batch.num_rows):
                col = lambda name: batch.column(name)[r].values
                ids = col("doc_ids").to_pylist()
                n = col("n_words").to_numpy(zero_copy_only=False).astype(np.int64)
                starts = np.cumsum(n + 1) - (n + 1)
                spans = [[] for _ in ids]
                items = [set() for _ in ids]
                if len(block.lens):
                    seg = Segment(col("terms").to_pylist(), col("ends").to_numpy(zero_copy_only=False),
                                  col("positions").to_numpy(zero_copy_only=False))
                    phrase, place = block.find(seg, slop, (starts, n))
                    doc = np.searchsorted(starts, place, side="right") - 1
                    rel = place - starts[doc]
                    for p, d, a in zip(phrase.tolist(), doc.tolist(), rel.tolist()):
                        b = a + int(block.lens[p])
                        if b <= n[d] or slop:
                            spans[d].append((a, min(b, int(n[d]))))
                            items[d].update(owners[p])
                yield pa.record_batch(
                    [pa.array(ids, pa.int64()), pa.array(n),
                     pa.array([[{"a": a, "b": b} for a, b in merged_ranges(s)] for s in spans], HIT_SCHEMA.field("spans").type),
                     pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                     pa.array([batch.column("segment")[r].as_py()] * len(ids), pa.string()),
                     pa.array(np.arange(len(ids)))], schema=HIT_SCHEMA)

    HIT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                            ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                            ("items", pa.list_(pa.string())), ("segment", pa.string()), ("row", pa.int64())])
    return tidy(find)


def decontaminate(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items of every document against all items."""
    hits = search(build_index(docs), items, n=n)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s.b - s.a).cast("long"))
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), "items")


def clean(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """``docs`` without the hit documents, columns unchanged."""
    hit = decontaminate(docs, items, n).filter("n_hit > 0").select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)
