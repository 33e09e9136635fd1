"""MinHash samples, bands and odd sketches of shingle sets, prefixes and parity
bitmaps that miss no pair, and the bucketed similarity join on either.

``similar_components`` links items whose shingle sets have a Jaccard
similarity of at least a threshold.  Items that share a bucket are
candidates.  Every bucket is first linked as a star around its smallest item,
which is linear in its size; the links are verified on the full sets and give
first components.  Pairs that the stars did not try matter only where a bucket
still holds several components; there the members are compared by their odd
sketches in bounded blocks, the most alike first, and verified on the spot
until their components meet, so a bucket yields links but never its pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, as_long, flat_shingles, marked, mix, shingles, written
from .components import components

# Members of a bucket compared in one block.
BLOCK = 1024
# Set elements held for one block.
BLOCK_ELEMENTS = 1 << 20


@dataclass(frozen=True)
class Scheme:
    """Parameters of a similarity join."""

    words: int              # shingle width
    percent: int            # least Jaccard similarity, in per cent
    bands: int
    rows: int               # MinHash samples per band
    samples: int            # samples in an odd sketch
    bits: int               # bits of an odd sketch
    sigmas: float = 5.0     # distance kept from the threshold when sketches decide

    def recall(self, similarity: float) -> float:
        return 1 - (1 - similarity ** self.rows) ** self.bands

    def most_odd_bits(self, elements) -> int:
        """Largest XOR population count of sketches whose sets may reach the
        threshold: the expected count at a similarity ``sigmas`` standard
        errors of the sample below it; ``elements`` (of both sets) do not matter."""
        j = self.percent / 100
        low = max(0.0, j - self.sigmas * math.sqrt(j * (1 - j) / self.samples))
        return math.ceil(self.bits * (1 - math.exp(-4 * self.samples * (1 - low) / self.bits)) / 2)

    def keys(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket keys of non-empty sets laid out in ``flat`` and their number per set."""
        keys = band_keys(samples_of(flat, starts, self.bands * self.rows), self.bands, self.rows)
        return keys.ravel(), np.full(len(starts), self.bands)

    def sketch(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return odd_sketches(samples_of(flat, starts, self.samples), self.bits)


@dataclass(frozen=True)
class Prefixes:
    """Parameters of a similarity join that misses no pair: in one order of all
    elements, sets that reach the threshold share one of the first few of each,
    and parity bitmaps of whole sets differ in no more bits than the sets in
    elements."""

    words: int              # shingle width
    percent: int            # least Jaccard similarity, in per cent
    bits: int               # bits of a parity bitmap

    def most_odd_bits(self, elements):
        """Largest symmetric difference of sets that reach the threshold and
        have so many elements together."""
        return elements * (100 - self.percent) / (100 + self.percent)

    def keys(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As in ``Scheme``; the keys are the smallest elements of a set, one
        more than a set that reaches the threshold with it may lack."""
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(flat))))
        flat = flat[np.lexsort((flat, of))]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])
        flat, of = flat[new], of[new]
        sizes = np.bincount(of, minlength=len(starts))
        rank = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[of]
        counts = sizes * (100 - self.percent) // 100 + 1
        return flat[rank < counts[of]], counts

    def sketch(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = len(starts)
        of = np.repeat(np.arange(n), np.diff(np.append(starts, len(flat))))
        at = of * self.bits + (flat % np.uint64(self.bits)).astype(np.int64)
        parity = (np.bincount(at, minlength=n * self.bits) & 1).astype(np.uint8)
        return np.packbits(parity.reshape(n, self.bits), axis=1)


@dataclass(frozen=True)
class Banded(Prefixes):
    """Parameters of a banded join whose candidates are verified with parity
    bitmaps of whole sets, so only its bands can miss a pair."""

    bands: int              # MinHash bands
    rows: int               # samples per band

    def recall(self, similarity: float) -> float:
        return 1 - (1 - similarity ** self.rows) ** self.bands

    def keys(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = band_keys(samples_of(flat, starts, self.bands * self.rows), self.bands, self.rows)
        return keys.ravel(), np.full(len(starts), self.bands)


def tuned(words: int, percent: int, recall: float, max_bands: int, samples: int, bits: int) -> Scheme:
    """The widest bands (fewest false candidates) that reach ``recall`` at the
    threshold with at most ``max_bands`` bands."""
    j = percent / 100
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - j ** rows))
        if bands <= max_bands:
            best = Scheme(words, percent, bands, rows, samples, bits)
    if best is None:
        raise ValueError("no banding reaches this recall with so few bands")
    return best


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seed[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seed[n:] >> np.uint64(32)).astype(np.uint32)


def samples_of(flat: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """MinHash samples (rows: sets) of non-empty sets laid out in ``flat``."""
    mul, xor = _constants(n)
    high = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((n, len(starts)), np.uint32)
    work = np.empty_like(high)
    for i in range(n):
        np.bitwise_xor(high, xor[i], out=work)
        np.multiply(work, mul[i], out=work)
        out[i] = np.minimum.reduceat(work, starts)
    return out.T


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = samples[:, :bands * rows].reshape(len(samples), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(samples), bands)).copy()
    for r in range(rows):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + part[:, :, r])
    return key


def odd_sketches(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps: every (sample number, value) toggles one bit."""
    n, k = samples.shape
    tag = np.arange(1, k + 1, dtype=np.uint64) << np.uint64(32)
    bit = (mix(samples.astype(np.uint64) + tag) % np.uint64(bits)).astype(np.int64)
    flat = np.arange(n)[:, None] * bits + bit
    parity = (np.bincount(flat.ravel(), minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(n, bits), axis=1)


class SetMaker:
    """Distinct shingle hashes of lists of words."""

    def __init__(self, words: int):
        self.width, self.hasher = words, WordHasher()

    def __call__(self, word_lists: list[list[bytes]]) -> list[np.ndarray]:
        hashes = self.hasher([w for ws in word_lists for w in ws])
        out, at = [], 0
        for ws in word_lists:
            out.append(np.unique(shingles(hashes[at:at + len(ws)], self.width)))
            at += len(ws)
        return out


def sequence_columns(word_lists: list[list[bytes]], hasher: WordHasher, scheme: Scheme | Prefixes) -> dict[str, pa.Array]:
    """As ``sketch_columns`` with the number of shingle places for n_shingles
    and the digest of the word sequence instead of the set's: equal sequences
    have equal sets, and other equal sets have equal keys.  Every list needs a
    word.  Fewer words than the shingle width need no keys: only an equal
    sequence has their one shingle."""
    lens = np.array([len(w) for w in word_lists], np.int64)
    flat, starts = flat_shingles(hasher([w for ws in word_lists for w in ws]), lens, scheme.words)
    keys, n_keys = scheme.keys(flat, starts)
    keys, n_keys = keys[np.repeat(lens >= scheme.words, n_keys)], np.where(lens >= scheme.words, n_keys, 0)
    digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(ws)) for ws in word_lists), np.int64).reshape(-1, 2)
    ends = np.cumsum([0, *n_keys], dtype=np.int32)
    return {"n_shingles": pa.array(np.maximum(lens - scheme.words + 1, 1)), "d1": pa.array(digest[:, 0]), "d2": pa.array(digest[:, 1]),
            "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(as_long(keys)))}


def sketch_columns(sets: list[np.ndarray], scheme: Scheme) -> dict[str, pa.Array]:
    """Arrow columns n_shingles, d1, d2 (digest of the set) and bands; an empty
    set has neither digest nor bands."""
    full = [i for i, s in enumerate(sets) if len(s)]
    keys = np.empty((0, scheme.bands), np.uint64)
    if full:
        starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        keys = band_keys(samples_of(np.concatenate([sets[i] for i in full]), starts, scheme.bands * scheme.rows),
                         scheme.bands, scheme.rows)
    digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
    ends = np.zeros(len(sets) + 1, np.int32)
    ends[1:][full] = scheme.bands
    return {
        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
        "d1": pa.array([d and int.from_bytes(d[:8], "little", signed=True) for d in digest], pa.int64()),
        "d2": pa.array([d and int.from_bytes(d[8:], "little", signed=True) for d in digest], pa.int64()),
        "bands": pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(as_long(keys.ravel()))),
    }


SKETCH = "n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>"
SETS = "m int, s binary, odd binary"


def set_columns(sets: list[np.ndarray], scheme: Scheme | Prefixes) -> dict[str, pa.Array]:
    """Arrow columns m (size), s (the sorted set, 8 bytes an element) and odd
    (its odd sketch) of non-empty sets."""
    odd = np.empty((0, scheme.bits // 8), np.uint8)
    if sets:
        starts = np.cumsum([0, *map(len, sets[:-1])])
        odd = scheme.sketch(np.concatenate(sets), starts)
    return {"m": pa.array([len(s) for s in sets], pa.int32()), "s": pa.array([s.tobytes() for s in sets], pa.binary()),
            "odd": pa.array([o.tobytes() for o in odd], pa.binary())}


def classes_of(sketched: DataFrame) -> DataFrame:
    """One row per distinct non-empty set: d1, d2, id (smallest), n (copies), bands."""
    return sketched.filter("d1 is not null").groupBy("d1", "d2").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))


def sharing(classes: DataFrame) -> DataFrame:
    """The ids (one column, distinct) of the classes that share a key of
    ``bands`` with another class.

    Most keys are a single class's: a key is counted with its smallest and
    largest id, which are all of a pair, and only keys of three classes and more
    are looked up among the classes again, past a bitmap of those keys.
    """
    members = classes.select("id", F.explode("bands").alias("key"))
    keys = members.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    keys = written(keys, "keys")
    many = keys.filter("n > 2").select("key")
    rest = members.filter(marked(many, "key")("key")).join(many, "key", "left_semi").select("id")
    return keys.select(F.explode(F.array("a", "b")).alias("id")).unionByName(rest).distinct()


def similar_components(classes: DataFrame, sets_of, scheme: Scheme | Prefixes) -> DataFrame:
    """(id, component) of the class representatives that have a similar one.

    ``sets_of(ids)`` returns (id, m, s, odd) for the given ids, or is such a
    written table.
    """
    members = classes.select("id", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(members.join(buckets, "key"), "buckets")
    sets = sets_of if isinstance(sets_of, DataFrame) else written(sets_of(shared.select("id").distinct()), "sets")

    stars = shared.filter("id != pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    links = written(verified(stars, sets, scheme), "verified")
    first = components(links)

    # Buckets of three and more that still hold several components.
    of = first.select("id", "component")
    placed = shared.filter("n > 2").join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = written(placed, "placed")
    sizes = sets.select("id", "m")
    mixed = placed.join(sizes, "id").groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n_members"), F.sum("m").alias("n_elements"),
        F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x2")) \
        .filter("lo != hi")
    # of buckets with the same members (128 bits of hashes agree), one is enough
    mixed = mixed.groupBy("n_members", "n_elements", "x1", "x2").agg(F.min("key").alias("key")).select("key", F.ceil(F.greatest(F.col("n_members") / BLOCK, F.col("n_elements") / BLOCK_ELEMENTS)).cast("int").alias("blocks"))
    more = links_in_blocks(placed.join(mixed, "key").filter("id != pivot").select("key", "id", "component", "blocks"), sets, scheme)
    more = written(more, "verified")
    if more.isEmpty():
        return first
    la = of.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    lb = of.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    roots = more.join(la, "a", "left").join(lb, "b", "left") \
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = written(components(roots), "components")
    up = second.select(F.col("id").alias("component"), F.col("component").alias("root"))
    moved = of.join(up, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    lone = second.join(of.select("id"), "id", "left_anti")
    return moved.unionByName(lone)


def odd_bits(a: str, b: str):
    """XOR population count of two binary odd sketches."""
    @F.arrow_udf("int")
    def count(x: pa.Array, y: pa.Array) -> pa.Array:
        n = len(x)
        if not n:
            return pa.array([], pa.int32())
        both = [np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(n, -1) for v in (x, y)]
        return pa.array(np.bitwise_count(both[0] ^ both[1]).sum(1, dtype=np.int32), pa.int32())
    return count(a, b)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def common_elements(a: str, b: str):
    @F.arrow_udf("int")
    def count(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([common(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64))
                         for p, q in zip(x.to_pylist(), y.to_pylist())], pa.int32())
    return count(a, b)


def verified(pairs: DataFrame, sets: DataFrame, scheme: Scheme | Prefixes) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.  The odd sketches
    go first and spare most other pairs the transport of their sets."""
    odd = sets.select("id", "odd", "m")
    oa, ob = (odd.select(F.col("id").alias(x), F.col("odd").alias(f"o{x}"), F.col("m").alias(f"m{x}")) for x in "ab")
    near = pairs.join(oa, "a").join(ob, "b") \
        .filter((100 * F.least("ma", "mb") >= scheme.percent * F.greatest("ma", "mb"))) \
        .withColumn("z", odd_bits("oa", "ob")).filter(F.col("z") <= scheme.most_odd_bits(F.col("ma") + F.col("mb"))).select("a", "b", "ma", "mb")
    sa, sb = (sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    return near.join(sa, "a").join(sb, "b").withColumn("both", common_elements("sa", "sb")) \
        .filter(100 * F.col("both") >= scheme.percent * (F.col("ma") + F.col("mb") - F.col("both"))).select("a", "b")


def links_in_blocks(members: DataFrame, sets: DataFrame, scheme: Scheme | Prefixes) -> DataFrame:
    """Verified links (a, b) that join the components of the members (key, id,
    component, blocks) of a bucket, as far as they can be joined.

    A large bucket is cut into blocks, and every pair of blocks is a group of
    its own, so no task holds a whole bucket.  Pairs already in one component,
    of too different sizes, or with too many odd bits are passed over; the rest
    are verified in the order of their odd bits.
    """
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = members.withColumn("own", own) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component") \
        .join(sets, "id")
    percent = scheme.percent
    cols = ["key", "i", "j", "own", "id", "component", "m", "s", "odd"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def plausible(rows):
        """(odd bits, x, y) of the pairs worth verifying."""
        n = len(rows["id"])
        odd = np.frombuffer(b"".join(rows["odd"]), np.uint8).reshape(n, -1)
        if odd.shape[1] % 8 == 0:
            odd = odd.view(np.uint64)
        comp, size, own = (np.array(rows[c], np.int64) for c in ("component", "m", "own"))
        cross = rows["i"][0] != rows["j"][0]
        found = []
        for x in range(n - 1):
            ok = comp[x + 1:] != comp[x]
            if cross:
                ok &= own[x + 1:] != own[x]
            ok &= 100 * np.minimum(size[x], size[x + 1:]) >= percent * np.maximum(size[x], size[x + 1:])
            at = np.flatnonzero(ok) + x + 1
            if len(at):
                z = np.bitwise_count(odd[at] ^ odd[x]).sum(1, dtype=np.int64)
                near = z <= scheme.most_odd_bits(size[x] + size[at])
                found.append(np.stack([z[near], np.full(near.sum(), x), at[near]], 1))
        if not found:
            return []
        found = np.concatenate(found)
        return found[np.argsort(found[:, 0], kind="stable")][:, 1:].tolist()

    def solve(rows):
        comp, out = rows["component"], []
        root = {c: c for c in comp}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        sets = {}
        for x, y in plausible(rows):
            cx, cy = find(comp[x]), find(comp[y])
            if cx == cy:
                continue
            for k in (x, y):
                if k not in sets:
                    sets[k] = np.frombuffer(rows["s"][k], np.uint64)
            both = common(sets[x], sets[y])
            if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                root[max(cx, cy)] = min(cx, cy)
                out.append((rows["id"][x], rows["id"][y]))
        return out

    def runs(it):
        held, here = None, None
        for batch in it:
            data = [batch.column(c).to_pylist() for c in cols]
            out = []
            for row in zip(*data):
                if row[:3] != here:
                    out += solve(held) if held and len(held["id"]) > 1 else []
                    held, here = {c: [] for c in cols}, row[:3]
                for c, v in zip(cols, row):
                    held[c].append(v)
            if out:
                yield pa.record_batch([pa.array(v, pa.int64()) for v in zip(*out)], schema=schema)
        out = solve(held) if held and len(held["id"]) > 1 else []
        if out:
            yield pa.record_batch([pa.array(v, pa.int64()) for v in zip(*out)], schema=schema)

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j") \
        .mapInArrow(runs, "a bigint, b bigint").distinct()
