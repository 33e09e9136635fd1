"""Periodic runs of words by descending-LCP Kruskal.

A text is a sequence of words.  A run is a stretch of consecutive words with
smallest period q that no neighbouring word extends; wanted are runs of at
least ``min_length`` words and ``exponent`` periods.  If i < j are the first
two places of a run's word cycle, the suffixes at i and j agree on all but the
first q words of the run, and no place between them agrees with both as long.
So the suffixes of a text are sorted, neighbours in that order are edges
weighted by their longest common prefix (LCP), and the classes of suffixes are
united by decreasing LCP: every class keeps its places in ascending order, the
smaller one moves into the larger, and two places that become neighbours at a
distance within the LCP are a seed.  A seed whose preceding words differ is a
whole run: its period is the distance, its end is given by the LCP.

Suffixes whose LCP is below ``floor_of(min_length, exponent)`` words cannot
seed a wanted run.  Windows of the largest power of two up to that are ranked
for many texts at once, and only texts that hold a window twice are sorted.

A text is one row and is handled by one task, in memory linear in its words
times the logarithm of its longest repeat; texts are never put together.

Defined results: words are split at ASCII white space; a null, empty or blank
text has no words and no runs and collapses to the empty string; repeated rows
give one row each; a row without doc_id stays, with null; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, columns, tidy

MIN_LENGTH = 24
EXPONENT = 3
# Places in one block of an ordered set.
BLOCK = 512

RUNS = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def floor_of(min_length: int, exponent: int) -> int:
    """Least LCP of a seed: a run of length l and period q has l - q, with
    l >= min_length and q <= l / exponent."""
    return -(-min_length * (exponent - 1) // exponent)


class Places:
    """Ascending distinct integers in blocks of bounded size, so that adding
    one to a large set moves few."""

    __slots__ = ("blocks", "lasts", "size")

    def __init__(self, first: int):
        self.blocks, self.lasts, self.size = [[first]], [first], 1

    def __iter__(self):
        for b in self.blocks:
            yield from b

    def around(self, x: int) -> tuple[int, int]:
        """The members before and after x (not a member), or -1."""
        k = bisect_left(self.lasts, x)
        if k == len(self.blocks):
            return self.lasts[-1], -1
        block = self.blocks[k]
        at = bisect_left(block, x)
        if at:
            return block[at - 1], block[at]
        return (self.lasts[k - 1] if k else -1), block[0]

    def add(self, x: int) -> None:
        k = min(bisect_left(self.lasts, x), len(self.blocks) - 1)
        block = self.blocks[k]
        block.insert(bisect_left(block, x), x)
        self.lasts[k] = block[-1]
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[k:k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.lasts[k:k + 1] = [block[BLOCK - 1], block[-1]]


def doubled(rank: np.ndarray, width: int, ends: np.ndarray) -> np.ndarray:
    """Ranks of windows of twice ``width`` from those of ``width``; a window
    that passes its text's end (``ends``) is cut there and equals no other."""
    n = len(rank)
    second = np.zeros(n, np.int64)
    inside = np.flatnonzero(np.arange(n) + width < ends)
    second[inside] = rank[inside + width] + 1
    return np.unique(rank * np.int64(n + 1) + second, return_inverse=True)[1].astype(np.int64)


def edges_of(words: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in suffix order and their LCP, where it reaches ``floor``,
    the greatest first."""
    n = len(words)
    ends = np.full(n, n)
    levels, width = [np.unique(words, return_inverse=True)[1].astype(np.int64)], 1
    while width < n and int(levels[-1].max()) + 1 < n:
        levels.append(doubled(levels[-1], width, ends))
        width *= 2
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1], order[1:]
    near = levels[min(floor.bit_length() - 1, len(levels) - 1)]
    near = near[a] == near[b]              # equal on the largest power of two up to the floor
    a, b = a[near], b[near]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        ok = np.maximum(x, y) < n
        same = np.zeros(len(a), bool)
        same[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        # cut windows at different places are never equal, so equal ranks are whole windows
        lcp[same] += 1 << k
    good = np.flatnonzero(lcp >= floor)
    good = good[np.argsort(-lcp[good], kind="stable")]
    return a[good], b[good], lcp[good]


def runs_of(words: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs, by start and period; ``words`` are
    word numbers."""
    if len(words) < min_length:
        return []
    ea, eb, el = edges_of(words, floor_of(min_length, exponent))
    word = words.tolist()
    parent: dict[int, int] = {}
    places: dict[int, Places] = {}
    out = []

    def find(x):
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    def seed(i, j, lcp):
        period = j - i
        if (exponent - 1) * period <= lcp and period + lcp >= min_length and (i == 0 or word[i - 1] != word[j - 1]):
            out.append((i, period + lcp, period))

    for a, b, lcp in zip(ea.tolist(), eb.tolist(), el.tolist()):
        a, b = find(a), find(b)
        big, small = places.pop(a, None) or Places(a), places.pop(b, None) or Places(b)
        if big.size < small.size:
            a, b, big, small = b, a, small, big
        moved = list(small)
        last = -1
        for k, x in enumerate(moved):
            before, after = big.around(x)
            if before > last:              # else the place before x is its old neighbour
                seed(before, x, lcp)
            if after >= 0 and (k + 1 == len(moved) or after < moved[k + 1]):
                seed(x, after, lcp)
            last = x
        for x in moved:
            big.add(x)
        parent[b] = a
        places[a] = big
    return sorted(out)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside of what follows a run's first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist())


def repeating(numbers: np.ndarray, lens: np.ndarray, floor: int) -> np.ndarray:
    """Which of the texts laid out in ``numbers`` hold a window of the largest
    power of two up to ``floor`` words twice."""
    ends = np.repeat(np.cumsum(lens), lens)
    rank, width = numbers, 1
    while 2 * width <= floor:
        rank = doubled(rank, width, ends)
        width *= 2
    of = np.repeat(np.arange(len(lens)), lens)
    whole = np.flatnonzero(np.arange(len(rank)) + width <= ends)
    _, first, count = np.unique(of[whole] * np.int64(len(rank) + 1) + rank[whole], return_index=True, return_counts=True)
    return np.unique(of[whole][first[count > 1]])


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT, doc_id: str = "doc_id", text: str = "text",
                  rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, its runs by start and period, and its text
    collapsed to one period per run.  ``rewrite`` may replace a document's
    words before they are searched."""
    floor = floor_of(min_length, exponent)
    d = columns(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))

    def search(it):
        for batch, texts in batches(it):
            ids = batch.column("doc_id").to_pylist()
            words = [t.split() if t else [] for t in texts]
            if rewrite is not None:
                words = [rewrite(i, w) for i, w in zip(ids, words)]
            lens = np.array([len(w) for w in words], np.int64)
            number: dict[bytes, int] = {}
            numbers = np.array([number.setdefault(x, len(number)) for w in words for x in w], np.int64)
            upto = np.cumsum(lens)
            runs = [[] for _ in words]
            if len(numbers):
                for k in repeating(numbers, lens, floor).tolist():
                    runs[k] = runs_of(numbers[upto[k] - lens[k]:upto[k]], min_length, exponent)
            rows = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(lens), pa.array(rows, SCHEMA[2].type),
                                   pa.array([collapsed(w, r).decode() for w, r in zip(words, runs)], pa.string())], schema=SCHEMA)

    SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                        ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())])
    return d.mapInArrow(tidy(search), RUNS)


def summary(found: DataFrame) -> DataFrame:
    """One row per document of ``periodic_runs``: the number of runs, the run
    of greatest exact length / period, and digests of all runs and the text."""
    none = F.expr("cast(null as struct<start: bigint, length: bigint, period: bigint>)")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                   r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
