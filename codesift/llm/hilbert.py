"""Hilbert-curve sharding.

Rows are placed on a grid of quantised metadata dimensions, ordered along the
Hilbert curve through that grid, and the order is cut into runs of equal row
counts.  A dimension is quantised by the order of its values, at cuts that
leave about as many rows between any two, so rows of one shard are close in
every dimension and min/max statistics of its files prune on each of them.

Defined results: null text counts as size 1 and CRC 0; null dimension values
form their own coordinate (0); rows of one cell are ordered by a hash of the
tie columns, then by these, whatever the size of the cell, and rows equal in
all of them take neighbouring slots in any order; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

# Rows per piece of a curve cell; a crowded cell is split into so many pieces.
PIECE_ROWS = 50_000


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows of ``coords``),
    each coordinate below 2**bits.

    Works from the top bit down: the cell of a point inside its current cube
    is read off as a Gray code after undoing the cube's reflection and
    rotation, which are then updated for the child cube.
    """
    pts = np.asarray(coords, np.int64)
    n, dims = pts.shape
    mask = (1 << dims) - 1
    entry = np.zeros(n, np.int64)       # corner where the curve enters the cube
    axis = np.zeros(n, np.int64)        # direction in which it crosses the cube
    index = np.zeros(n, np.int64)

    def rotate_right(x, by):
        by = by % dims
        return ((x >> by) | (x << (dims - by))) & mask

    def rotate_left(x, by):
        by = by % dims
        return ((x << by) | (x >> (dims - by))) & mask

    for level in range(bits - 1, -1, -1):
        corner = np.zeros(n, np.int64)
        for d in range(dims):
            corner |= ((pts[:, d] >> level) & 1) << d
        code = rotate_right(corner ^ entry, axis + 1)
        rank = code.copy()               # inverse Gray code
        shift = 1
        while shift < dims:
            rank ^= rank >> shift
            shift *= 2
        index = (index << dims) | rank
        # entry corner and crossing direction of child cube number ``rank``
        before = np.where(rank == 0, 0, 2 * ((rank - 1) // 2))
        child_entry = np.where(rank == 0, 0, before ^ (before >> 1))
        odd = np.where(rank % 2 == 0, rank - 1, rank)
        trailing = np.zeros(n, np.int64)
        probe = np.where(rank == 0, 0, odd)
        running = rank > 0
        for _ in range(dims):
            running &= (probe & 1) == 1
            trailing += running
            probe >>= 1
        child_axis = np.where(rank == 0, 0, trailing % dims)
        entry ^= rotate_left(child_entry, axis + 1)
        axis = (axis + child_axis + 1) % dims
    return index


def hilbert_order(df: DataFrame, dims: list[Column], tie: list[Column], bits: int = 5) -> DataFrame:
    """``df`` with ``_rank``: the row's place (from 0) along the curve, ties
    inside a cell by ``tie``, and ``_total``, the number of rows.

    ``dims`` are integer columns, clipped to [0, 2**bits).  The occupied cells
    are at most 2**(bits * len(dims)) rows, which bounds the broadcast; ranks
    inside a cell are counted in pieces, so no task sorts a whole hot cell.
    """
    n_dims = len(dims)
    assert bits * n_dims <= 16, "the table of cells is broadcast; keep it small"
    top = (1 << bits) - 1
    names = [f"_d{i}" for i in range(n_dims)]

    @F.pandas_udf("long")
    def curve(*cs: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy(np.int64) for c in cs], 1), bits))

    keyed = df.select("*", *[F.least(F.greatest(F.coalesce(c.cast("int"), F.lit(0)), F.lit(0)), F.lit(top)).alias(n)
                             for n, c in zip(names, dims)],
                      F.shiftrightunsigned(F.xxhash64(*tie), 1).alias("_h"))
    keyed = written(keyed, "hilbert")
    cells = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_curve", curve(*names)) \
        .withColumn("_pieces", F.ceil(F.col("_n") / F.lit(PIECE_ROWS)).cast("long"))
    cells = written(cells, "cells")
    whole = Window.orderBy("_curve").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_curve").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.withColumn("_start", F.coalesce(F.sum("_n").over(whole), F.lit(0))) \
        .withColumn("_total", F.sum("_n").over(everything))
    # a piece is a range of hashes, so the order is by the hash at every number of pieces
    placed = keyed.join(F.broadcast(cells), names) \
        .withColumn("_piece", F.shiftright(F.shiftright("_h", 32) * F.col("_pieces"), 31))
    pieces = placed.groupBy("_curve", "_piece").agg(F.count(F.lit(1)).alias("_m"))
    inside = Window.partitionBy("_curve").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_curve", "_piece", F.coalesce(F.sum("_m").over(inside), F.lit(0)).alias("_before"))
    order = Window.partitionBy("_curve", "_piece").orderBy("_h", *tie)
    return (placed.withColumn("_row", F.row_number().over(order))
            .join(pieces, ["_curve", "_piece"])
            .withColumn("_rank", F.col("_start") + F.col("_before") + F.col("_row") - 1)
            .drop(*names, "_h", "_n", "_pieces", "_start", "_before", "_row", "_piece"))


def cut_runs(ranked: DataFrame, shards: int) -> DataFrame:
    """Cut the curve order into ``shards`` runs whose row counts differ by one
    at most: adds ``shard`` and ``slot`` (from 0 inside the shard)."""
    small = F.expr(f"_total div {int(shards)}")
    extra = F.expr(f"_total % {int(shards)}")
    head = extra * (small + 1)           # the first ``extra`` shards hold one row more
    shard = F.when(F.col("_rank") < head, F.expr(f"_rank div (_total div {int(shards)} + 1)")) \
        .otherwise(extra + F.expr(f"(_rank - (_total % {int(shards)}) * (_total div {int(shards)} + 1))"
                                  f" div greatest(_total div {int(shards)}, 1)"))
    out = ranked.withColumn("shard", shard.cast("int"))
    start = F.when(F.col("shard") < extra, F.col("shard") * (small + 1)).otherwise(head + (F.col("shard") - extra) * small)
    return out.withColumn("slot", (F.col("_rank") - start).cast("long"))


def write_shards(sharded: DataFrame, path: str, tasks: int = 200) -> None:
    """One folder per shard with files in curve order, each a range of slots."""
    sharded.repartitionByRange(tasks, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def text_cuts(df: DataFrame, names: list[str], coordinates: int) -> dict[str, tuple[int, list[int]]]:
    """For each text column where its codes begin (after the prefix that all
    its values share) and the codes at which ``coordinates`` equal counts of
    rows are cut."""
    ends = df.agg(*[f(F.col(c).cast("binary")).alias(f"{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    skip = {}
    for c in names:
        lo, hi = bytes(ends[f"lo_{c}"] or b""), bytes(ends[f"hi_{c}"] or b"")
        skip[c] = next((k for k, (x, y) in enumerate(zip(lo, hi)) if x != y), min(len(lo), len(hi)))
    at = [k / coordinates for k in range(1, coordinates)]
    cuts = df.agg(*[F.percentile_approx(text_code(c, skip[c]), at, 100_000).alias(c) for c in names]).first()
    return {c: (skip[c], list(cuts[c] or [])) for c in names}


def text_code(name: str, skip: int) -> Column:
    """The seven bytes of a text after its first ``skip`` as a number; texts
    in byte order have codes in order."""
    part = F.substring(F.col(name).cast("binary"), skip + 1, 7)
    return F.conv(F.rpad(F.hex(part), 14, "0"), 16, 10).cast("long")


def document_dims(docs: DataFrame | None = None, lang: str = "lang", source: str = "source", size: str = "size", bits: int = 5) -> list[Column]:
    """Metadata dimensions of a document: language and source by the order of
    their values, cut to equal counts over ``docs``, and size by powers of the
    square root of two.  Without ``docs`` languages and sources are hashed
    instead, which keeps equal values together but not neighbouring ones."""
    length = F.floor(F.log2(F.col(size).cast("double")) * 1.5)
    if docs is None:
        return [F.when(F.col(c).isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(c), F.lit((1 << bits) - 1))) for c in (lang, source)] + [length]
    out = []
    for c, (skip, cuts) in text_cuts(docs, [lang, source], (1 << bits) - 1).items():
        code = text_code(c, skip)
        above = sum(((code > F.lit(x)).cast("int") for x in cuts), F.lit(0))
        out.append(F.when(F.col(c).isNull(), F.lit(0)).otherwise(1 + above))
    return [*out, length]
