"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte is removed if it lies in a string of ``length`` bytes that also starts
earlier (smaller doc_id, or the same document at a smaller offset); strings
never cross documents and are judged on the input.

1.  Anchors.  Every window of ``length`` bytes is represented by its minimizer,
    the smallest hash of the ``GRAM``-byte strings in it, so equal windows have
    the same anchor at the same place.  Consecutive windows with one anchor
    form a region; a region's context is the hash of all its bytes.  Only
    anchors, about one per 35 bytes, are shuffled.
2.  Equal contexts.  Of regions with equal anchor and context all but the
    earliest are repeats as a whole.  This is done inside each task before the
    shuffle, and again after it.
3.  Longest previous factors.  Anchors that occur in different contexts (the
    edges of repeats) get their bytes back.  Their suffixes are put in suffix
    order, neighbours' common prefixes are measured, and for each suffix the
    nearest suffixes in that order with a smaller position, to either side,
    give its longest previous factor.  Factors of ``length`` or more are repeats.

Contexts that are equal by their 64-bit hash and have equal 64-bit anchors
count as equal; step 3 compares bytes.  An anchor with very many contexts is
dealt out by whole windows instead, so no task holds a hot group.

Defined results: null and empty texts and texts shorter than ``length`` keep
everything; rows without doc_id keep everything and cause no removal; of rows
that share a doc_id none is earlier than the other at the same offset, and a
span found in one is removed from all, clipped to each text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, batches, columns, mix, texts_of, tidy, written

LENGTH = 100
GRAM = 32
# Bytes handled at once: positions in a chunk fit the low bits of the order key.
CHUNK_BITS = 20
SLICE = 1 << 19
# Contexts of one anchor that are compared in one task.
GROUP = 20_000
# Window bytes compared at once in step 3.
BLOCK_WINDOWS = 100_000

ROWS = "kind int, h bigint, ctx bigint, doc_id bigint, lo int, hi int, at int"


def _table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 32-byte and all 64-byte strings of ``buf``, by doubling."""
    h = _table()[buf]
    by_width = {}
    width = 1
    while width < 64:
        n = max(0, len(h) - width)
        head = h[:n] * np.uint64(0xD1342543DE82EF95)
        head ^= head >> np.uint64(29)
        head += h[width:width + n]
        h = head
        width *= 2
        by_width[width] = h
    return by_width[GRAM], by_width[64]


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """Regions of windows with one anchor, over the slices [starts, ends) of
    ``buf``: slice number, first and last window, anchor, anchor hash, context."""
    empty = np.empty(0, np.int64)
    if len(buf) < length:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    gram, half = gram_hashes(buf)
    low = np.uint64((1 << CHUNK_BITS) - 1)
    # order key: high bits of the hash, then the position, so the leftmost wins ties
    least = (mix(gram) & ~low) | np.arange(len(gram), dtype=np.uint64)
    span = length - GRAM + 1
    done = 1
    while done < span:
        step = min(done, span - done)
        least = np.minimum(least[:len(least) - step], least[step:])
        done += step
    best = (least & low).astype(np.int64)           # per window start
    of = np.searchsorted(starts, np.arange(len(best)), side="right") - 1
    fits = np.arange(len(best)) + length <= ends[of]
    window = np.flatnonzero(fits)
    if not len(window):
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    best, of = best[window], of[window]
    new = np.r_[True, (best[1:] != best[:-1]) | (of[1:] != of[:-1]) | (np.diff(window) != 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(window)] - 1
    lo, hi, at = window[first], window[last], best[first]
    total = hi - lo + length                         # bytes of the region: at most 2 * length - GRAM
    ctx = half[lo] * np.uint64(0xA24BAED4963EE407)
    ctx = mix(ctx + half[lo + (total - 64) // 2]) * np.uint64(0x9FB21C651E98DF25)
    ctx = mix(ctx + half[hi + length - 64]) + (total * 4096 + (at - lo)).astype(np.uint64)
    return of[first], lo, hi, at, mix(gram[at] + np.uint64(1)), mix(ctx)


def merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Union of ranges [a, b) per document, sorted."""
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    if not len(doc):
        return doc, a, b
    # running end within a document: ends made comparable across documents
    change = np.r_[True, doc[1:] != doc[:-1]]
    run = np.cumsum(change) - 1
    lift = run.astype(np.int64) * (int(b.max()) + 1)
    reach = np.maximum.accumulate(b + lift)
    new = change | np.r_[True, a[1:] + lift[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    return doc[first], a[first], (reach - lift)[np.r_[first[1:], len(doc)] - 1]


def _scan(length: int):
    """Anchors of all documents, equal contexts reduced to the earliest in
    each chunk (kind 0), and what that reduction already covers (kind 1)."""
    def emit(kind, h, ctx, doc, lo, hi, at):
        return pa.record_batch(
            [pa.array(np.full(len(doc), kind, np.int32)), pa.array(as_long(h)), pa.array(as_long(ctx)),
             pa.array(doc), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(at.astype(np.int32))],
            ["kind", "h", "ctx", "doc_id", "lo", "hi", "at"])

    def chunk(slices):
        buf = np.frombuffer(b"".join(s for _, _, s in slices), np.uint8)
        size = np.array([len(s) for _, _, s in slices], np.int64)
        ends = np.cumsum(size)
        starts = ends - size
        of, lo, hi, at, h, ctx = anchors(buf, starts, ends, length)
        if not len(of):
            return
        doc = np.array([d for d, _, _ in slices], np.int64)[of]
        base = np.array([o for _, o, _ in slices], np.int64)[of] - starts[of]
        lo, hi, at = lo + base, hi + base, at - lo
        key = mix(h ^ (ctx * np.uint64(0x9E3779B97F4A7C15)))
        order = np.lexsort((lo, doc, key))
        k = key[order]
        again = np.zeros(len(k), bool)
        again[order] = np.r_[False, k[1:] == k[:-1]]
        # the earliest of a run at the very place of another row is no repeat
        rest = ~again
        yield emit(0, h[rest], ctx[rest], doc[rest], lo[rest], hi[rest], at[rest])
        if again.any():
            first = order[np.maximum.accumulate(np.where(np.r_[True, k[1:] != k[:-1]], np.arange(len(k)), 0))]
            origin = np.empty(len(k), np.int64)
            origin[order] = first
            real = again & ((doc != doc[origin]) | (lo != lo[origin]))
            d, a, b = merged(doc[real], lo[real], hi[real] + length)
            # spread over the partitions by document
            yield emit(1, mix(d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.zeros(len(d), np.uint64), d, a, b, a * 0)

    def scan(it):
        held, size = [], 0
        for batch, texts in batches(it):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                if doc is None or not text or len(text) < length:
                    continue
                for o in range(0, max(1, len(text) - length + 1), SLICE - length + 1):
                    part = text[o:o + SLICE]
                    if size + len(part) > 1 << CHUNK_BITS:
                        yield from chunk(held)
                        held, size = [], 0
                    held.append((doc, o, part))
                    size += len(part)
        if held:
            yield from chunk(held)

    return tidy(scan)


def _reduce(length: int):
    """Over rows sorted by anchor, context and position: spans (kind 1) of all
    but the earliest region of a context, and the earliest regions (kind 2) of
    anchors that have several contexts.  Keeps one row between batches."""
    names = ["kind", "h", "ctx", "doc_id", "lo", "hi", "at"]

    def reduce(it):
        head = None         # earliest row of the current context, not yet settled
        shown = False       # it is already out, or its anchor has other contexts
        for batch in it:
            col = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names}
            ready = col["kind"] == 1
            if ready.any():
                yield batch.filter(pa.array(ready))
            col = {c: v[~ready] for c, v in col.items()}
            n = len(col["h"])
            if not n:
                continue
            if head is not None:
                col = {c: np.r_[head[c], v] for c, v in col.items()}
                n += 1
            h, ctx = col["h"], col["ctx"]
            new_h = np.r_[True, h[1:] != h[:-1]]
            new = new_h | np.r_[True, ctx[1:] != ctx[:-1]]
            first = np.flatnonzero(new)
            origin = first[np.cumsum(new) - 1]
            later = ~new & ((col["doc_id"] != col["doc_id"][origin]) | (col["lo"] != col["lo"][origin]))
            out = []
            if later.any():
                d, a, b = merged(col["doc_id"][later], col["lo"][later], col["hi"][later] + length)
                out.append((np.full(len(d), 1), a * 0, a * 0, d, a, b, a * 0))
            # a context is one of several if a neighbouring context has the same anchor
            same = h[first][1:] == h[first][:-1]
            several = np.r_[False, same] | np.r_[same, False]
            if head is not None:
                several[0] |= shown
            settled = several.copy()
            if head is not None and shown:
                settled[0] = False                        # is out already
            pick = first[settled]
            out.append((np.full(len(pick), 2), *(col[c][pick] for c in names[1:])))
            shown = bool(several[-1])
            head = {c: v[first[-1]:first[-1] + 1] for c, v in col.items()}
            for values in out:
                if len(values[0]):
                    yield pa.record_batch([pa.array(values[0].astype(np.int32)), *(pa.array(v.astype(np.int64)) for v in values[1:4]),
                                           *(pa.array(v.astype(np.int32)) for v in values[4:])], names)

    return tidy(reduce)


def longest_previous_factors(rank: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Of suffixes in suffix order: the longest common prefix of each with any
    suffix of smaller position.

    ``rank`` holds their positions in that order and ``lcp[i]`` the common
    prefix of suffixes i - 1 and i.  A stack of rising positions gives each
    suffix the nearest smaller position before it and, when the suffix is
    popped, the nearest smaller one after it.
    """
    n = len(rank)
    out = [0] * n
    pos, common = rank.tolist(), lcp.tolist()
    stack: list[int] = []       # indices with rising positions
    link: list[int] = []        # common prefix with the stack entry below
    for i in range(n):
        here = common[i] if i else 0
        while stack and pos[stack[-1]] > pos[i]:
            # i is the next smaller position of the entry on top
            top, below = stack.pop(), link.pop()
            out[top] = max(below, here)
            here = min(here, below)
        link.append(here if stack else 0)
        stack.append(i)
    while stack:
        top = stack.pop()
        out[top] = link.pop()   # no smaller position after it
    return np.array(out, np.int64)


def repeated_windows(group: np.ndarray, doc: np.ndarray, pos: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which windows (rows of ``text``, bytes) have an equal one of smaller
    (doc, pos) in their group, by longest previous factors."""
    n, length = text.shape
    wide = np.zeros((n, -(-length // 8) * 8), np.uint8)
    wide[:, :length] = text
    words = wide.view(">u8").astype(np.uint64)
    order = np.lexsort([*(words[:, j] for j in range(words.shape[1] - 1, -1, -1)), group])
    s, g = text[order], group[order]
    differs = s[1:] != s[:-1]
    lcp = np.where(differs.any(1), differs.argmax(1), length)
    lcp = np.r_[0, np.where(g[1:] == g[:-1], lcp, 0)]
    place = np.lexsort((pos, doc))
    d, p = doc[place], pos[place]
    step = np.r_[0, (d[1:] != d[:-1]) | (p[1:] != p[:-1])] if n else np.empty(0, bool)
    rank = np.empty(n, np.int64)
    rank[place] = np.cumsum(step)
    factor = np.empty(n, np.int64)
    factor[order] = longest_previous_factors(rank[order], lcp)
    return factor >= length


REGION = "h bigint, doc_id bigint, lo int, region binary"


def _factors(length: int):
    """Spans of repeated windows among the regions of each anchor; the rows
    come sorted by anchor."""
    def solve(rows):
        h = np.array([r[0] for r in rows], np.int64)
        n = np.array([len(r[3]) - length + 1 for r in rows], np.int64)
        size = np.array([len(r[3]) for r in rows], np.int64)
        buf = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        of = np.repeat(np.arange(len(rows)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text = np.lib.stride_tricks.sliding_window_view(buf, length)[(np.cumsum(size) - size)[of] + inside]
        doc = np.array([r[1] for r in rows], np.int64)[of]
        pos = np.array([r[2] for r in rows], np.int64)[of] + inside
        hit = repeated_windows(h[of], doc, pos, text)
        d, a, b = merged(doc[hit], pos[hit], pos[hit] + length)
        return pa.record_batch([pa.array(d), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["doc_id", "a", "b"])

    def factors(it):
        held, windows = [], 0
        for batch in it:
            for row in zip(batch.column("h").to_pylist(), batch.column("doc_id").to_pylist(),
                           batch.column("lo").to_pylist(), batch.column("region").to_pylist()):
                if held and windows > BLOCK_WINDOWS and row[0] != held[-1][0]:
                    yield solve(held)
                    held, windows = [], 0
                held.append(row)
                windows += len(row[3]) - length + 1
        if held:
            yield solve(held)

    return tidy(factors)


SPAN = "array<struct<a:int,b:int>>"
PLACE = "array<struct<h:bigint,lo:int,hi:int>>"


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): ``texts`` has doc_id, n_bytes, text_sha256, and text
    only where something may be removed; ``spans`` has doc_id and a, b."""
    assert length >= 64 + GRAM // 2, "regions are hashed by three 64-byte strings"
    d = columns(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = d.mapInArrow(_scan(length), ROWS)
    settled = written(rows.repartition("h").sortWithinPartitions("h", "ctx", "doc_id", "lo")
                      .mapInArrow(_reduce(length), ROWS), "regions")
    hot = settled.filter("kind = 2").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP).select("h")
    found = settled.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("kind") == 1, F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")))).alias("spans"),
        F.collect_list(F.when(F.col("kind") == 2, F.struct("h", "lo", "hi"))).alias("places"))         .filter("doc_id is not null").withColumnRenamed("doc_id", "found_id")
    joined = d.join(found, F.col("doc_id") == F.col("found_id"), "left")
    touched = F.col("found_id").isNotNull()
    utf8 = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = written(joined.select(
        "doc_id", F.octet_length(utf8).cast("long").alias("n_bytes"), F.sha2(utf8, 256).alias("text_sha256"),
        F.when(touched, F.col("text")).alias("text"), F.coalesce("spans", F.array().cast(SPAN)).alias("spans"),
        F.coalesce("places", F.array().cast(PLACE)).alias("places")), "texts")

    regions = texts.filter(F.size("places") > 0).select("doc_id", F.col("text").cast("binary").alias("t"), F.explode("places").alias("p"))         .select("p.h", "doc_id", "p.lo", F.expr(f"substring(t, p.lo + 1, p.hi - p.lo + {length})").alias("region"))
    # (a repeated doc_id may have a shorter text than the one its region came from)
    regions = written(regions.filter(F.octet_length("region") >= length), "edges")
    normal = regions.join(hot, "h", "left_anti") if not hot.isEmpty() else regions
    spans = normal.repartition("h").sortWithinPartitions("h").mapInArrow(_factors(length), "doc_id bigint, a int, b int")
    if not hot.isEmpty():
        spans = spans.unionByName(_by_window(regions.join(hot, "h", "left_semi"), length))
    first = texts.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.a", "s.b")
    return texts, first.unionByName(spans)


def _by_window(regions: DataFrame, length: int) -> DataFrame:
    """Repeated windows of anchors with very many contexts: every window is a
    row, and its earliest place is found by a pre-aggregated minimum."""
    starts = F.sequence(F.lit(0), F.octet_length("region") - length)
    window = regions.select("doc_id", "lo", "region", F.explode(starts).alias("o"))         .select("doc_id", (F.col("lo") + F.col("o")).alias("a"), F.expr(f"sha2(substring(region, o + 1, {length}), 256)").alias("w"))
    earliest = window.groupBy("w").agg(F.min(F.struct("doc_id", "a")).alias("e"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("w", "e")
    return window.join(earliest, "w").filter((F.col("doc_id") != F.col("e.doc_id")) | (F.col("a") != F.col("e.a")))         .select("doc_id", "a", (F.col("a") + length).cast("int").alias("b"))


def remaining(text: bytes, spans: list) -> tuple[bytes, int, int]:
    """What is left of ``text``, the bytes removed and the maximal runs removed."""
    kept, at, removed, runs, reach = [], 0, 0, 0, -1
    for a, b in sorted(spans):
        a, b = max(a, 0), min(b, len(text))
        if a >= b:
            continue
        if a > reach:
            runs += 1
        start = max(a, at)
        if start < b:
            kept.append(text[at:start])
            removed += b - start
            at = b
        reach = max(reach, b)
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def _apply(texts: DataFrame, spans: DataFrame):
    """Every row with its bytes removed: n_removed, n_spans, kept_sha256, kept."""
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("cut")).withColumnRenamed("doc_id", "cut_id")
    may = texts.filter("text is not null").select("doc_id", "n_bytes", "text_sha256", "text")         .join(by_doc, F.col("doc_id") == F.col("cut_id"), "left").drop("cut_id")

    @F.arrow_udf("struct<n_removed:bigint,n_spans:bigint,kept_sha256:string,kept:string>")
    def cut_out(text: pa.Array, cut: pa.Array) -> pa.Array:
        out = []
        for t, c in zip(texts_of(text), cut.to_pylist()):
            left, removed, runs = remaining(t, [(s["a"], s["b"]) for s in c or []])
            out.append({"n_removed": removed, "n_spans": runs, "kept_sha256": hashlib.sha256(left).hexdigest(),
                        "kept": left.decode("utf-8", "ignore")})
        return pa.array(out, pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]))

    done = may.withColumn("r", cut_out("text", "cut")).select("doc_id", "n_bytes", "r.*")
    zero = F.lit(0).cast("long")
    rest = texts.filter("text is null").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"),
                                               F.col("text_sha256").alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    return done.unionByName(rest)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return _apply(*repeated_spans(docs, length)).drop("kept")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated bytes taken out of the texts (and characters cut
    in half by that), n_chars counted anew; a document of which nothing is left
    goes.  Other columns are unchanged."""
    cut = written(_apply(*repeated_spans(docs, length)).filter("n_removed > 0").select("doc_id", "kept"), "cut")
    d, c = docs.alias("d"), cut.dropDuplicates(["doc_id"]).alias("c")
    changed = F.col("c.doc_id").isNotNull()
    new = {"text": F.when(changed, F.col("c.kept")).otherwise(F.col("d.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("c.kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("d.n_chars"))
    return d.join(c, F.col("d.doc_id") == F.col("c.doc_id"), "left").filter(~changed | (F.trim("c.kept") != "")) \
        .select(*[new.get(n, F.col(f"d.`{n}`")).alias(n) for n in docs.columns])
