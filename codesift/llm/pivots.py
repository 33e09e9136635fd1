"""Centroid clustering with Ptolemaic pivots.

Vectors of integers are clustered by Lloyd's rounds with integer centroids.
For points x, c and pivots p, s, Ptolemy's inequality gives

    d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s).

The distances of every vector to a few fixed pivots are computed once and
stored with it, those of the centroids once a round, so the bounds over the
fixed pivot pairs cost a few products and no pass over components.  The bounds
are rounded down by more than the error of their floating-point terms.  A
vector is compared exactly, in integers, with the centroid of the smallest
bound, and then with every other centroid whose bound does not exceed that
distance; ties go to the smaller number.

Tasks send one row of sums per centroid; the driver holds the ``k`` centroids
and the sums of each round, nothing that grows with the vectors.

Defined results: a vector is kept if it has exactly ``dims`` components, none
null or non-finite, and none beyond ``LIMIT`` after scaling, above which squared
distances do not fit a long; the others have no row.  Repeated rows are vectors
of their own; a row without vec_id is clustered and keeps its null, and can be
a first centroid only after all others.  Fewer than ``k`` vectors give as many
centroids; an empty table gives an empty result.  An inertia that does not fit
a long is null.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, tidy, written

# Components beyond this are left out: 64 squared differences fit a long.
LIMIT = 1 << 27
# Relative margin of the bounds, far above the error of their few operations.
MARGIN = 1e-12


def scaled(vectors: DataFrame, dims: int, scale: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): the kept vectors, every component floor(scale * x)."""
    d = columns(vectors, vec_id=vec_id, embedding=embedding)
    usable = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double") * scale) < LIMIT, F.lit(False)))
    return d.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dims)).filter(usable) \
        .select(F.col("vec_id").cast("long").alias("vec_id"),
                F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def first_centroids(points: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The vectors of the ``k`` smallest sha256 of ``seed:vec_id``; equal ids by
    their components."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = points.select(mark.alias("mark"), "v").orderBy(F.col("mark").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    diff = a - b
    return np.einsum("ij,ij->i", diff, diff)


def far_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the points, each the farthest from those before it, no two equal."""
    chosen = [0]
    gap = squared(points, points[0])
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, squared(points, points[chosen[-1]]))
    return points[chosen]


def pivot_distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (rows: points) to the pivots."""
    return np.sqrt(np.stack([squared(points, p) for p in pivots], 1).astype(np.float64))


def lower_bounds(near: np.ndarray, far: np.ndarray, pairs: list[tuple[int, int, float]]) -> np.ndarray:
    """Lower bounds of the squared distances (rows: points, columns: centroids)
    from both sides' pivot distances; ``pairs`` are two pivots and their distance."""
    best = np.zeros((len(near), len(far)))
    for p, s, apart in pairs:
        a = near[:, p:p + 1] * far[None, :, s]
        b = near[:, s:s + 1] * far[None, :, p]
        np.maximum(best, (np.abs(a - b) - MARGIN * (a + b)) / apart, out=best)
    return best * best * (1 - MARGIN)


class Assigner:
    """Nearest centroids of many points; counts the distances it computes."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids, self.exact = centroids, 0
        self.far = pivot_distances(centroids, pivots)
        self.pairs = [(p, s, float(np.sqrt(float(squared(pivots[p:p + 1], pivots[s])[0])))) for p, s in combinations(range(len(pivots)), 2)]

    def __call__(self, points: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of the points."""
        bounds = lower_bounds(near, self.far, self.pairs)
        guess = bounds.argmin(1)
        best, cluster = squared(points, self.centroids[guess]), guess.copy()
        self.exact += len(points)
        survives = bounds <= best[:, None]           # best only falls, so none that could win is missed
        survives[np.arange(len(points)), guess] = False
        for c in range(len(self.centroids)):
            at = np.flatnonzero(survives[:, c])
            if len(at):
                self.exact += len(at)
                d = squared(points[at], self.centroids[c])
                wins = (d < best[at]) | ((d == best[at]) & (c < cluster[at]))
                best[at[wins]], cluster[at[wins]] = d[wins], c
        return cluster, best


def _arrays(batch: pa.RecordBatch, dims: int, n_pivots: int) -> tuple[np.ndarray, np.ndarray]:
    points = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
    return points, batch.column("near").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_pivots)


def _with_pivots(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, v, near): the points with their cached pivot distances."""
    def add(it):
        for batch in it:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            near = pivot_distances(v, pivots) if len(v) else np.empty((0, len(pivots)))
            ends = np.arange(len(v) + 1, dtype=np.int32) * len(pivots)
            yield pa.record_batch([batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(pa.array(ends), pa.array(near.ravel()))],
                                  ["vec_id", "v", "near"])
    return points.mapInArrow(tidy(add), "vec_id bigint, v array<int>, near array<double>")


def _moved(cached: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dims = centroids.shape

    def sums(it):
        near_one = Assigner(centroids, pivots)
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in it:
            points, near = _arrays(batch, dims, len(pivots))
            cluster, _ = near_one(points, near)
            order = np.argsort(cluster, kind="stable")
            n = np.bincount(cluster, minlength=k)
            has = np.flatnonzero(n)
            if len(has):
                total[has] += np.add.reduceat(points[order], (np.cumsum(n) - n)[has], axis=0)
                count += n
        has = np.flatnonzero(count)
        yield pa.record_batch([pa.array(has, pa.int32()), pa.array(count[has], pa.int64()), pa.array(total[has].tolist(), pa.list_(pa.int64()))],
                              ["c", "n", "total"])

    parts = cached.mapInArrow(tidy(sums), "c int, n bigint, total array<bigint>")
    rows = parts.groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total")).collect()
    out = centroids.copy()
    for r in rows:                                   # at most k rows
        out[r.c] = [t // r.n for t in r.total]       # exact, rounded down
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, n_pivots: int = 6,
            vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), centroid (its
    components), cluster_inertia and inertia (sums of distances)."""
    spark = vectors.sparkSession
    schema = "vec_id bigint, cluster int, distance bigint, centroid array<bigint>, cluster_inertia bigint, inertia bigint"
    points = scaled(vectors, dims, scale, vec_id, embedding)
    centroids = first_centroids(points, k)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    pivots = far_pivots(centroids, n_pivots)
    cached = written(_with_pivots(points, pivots), "pivots")
    for _ in range(rounds):
        centroids = _moved(cached, centroids, pivots)

    def assign(it):
        near_one = Assigner(centroids, pivots)
        for batch in it:
            c, d = near_one(*_arrays(batch, dims, len(pivots)))
            yield pa.record_batch([batch.column("vec_id"), pa.array(c, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    placed = written(cached.mapInArrow(tidy(assign), "vec_id bigint, cluster int, distance bigint"), "clusters")
    sums = {r.cluster: r.d for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda x: int(x) if x < 1 << 63 else None
    rows = [(c, centroids[c].tolist(), fits(d), fits(sum(sums.values()))) for c, d in sums.items()]
    about = spark.createDataFrame(rows, "cluster int, centroid array<bigint>, cluster_inertia bigint, inertia bigint")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "centroid", "cluster_inertia", "inertia")


def centroid_digest(column: str):
    """Lowercase hex sha256 of the components as decimals joined by commas."""
    return F.sha2(F.array_join(F.transform(column, lambda x: x.cast("string")), ",").cast("binary"), 256)


def digest_of(centroid) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
