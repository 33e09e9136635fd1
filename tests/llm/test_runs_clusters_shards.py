"""Periodic runs, centroid clusters and wavelet shards against brute force, on
small tables that hold nulls, empty and long texts, ties, repeated rows, extra
columns with clashing names, and no rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codesift.llm import periodic, pivots, queries, wavelet

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, runs string, part string, before int, v string, near int, file string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "r", "p", 1, "v", 2, "f") for i, t in texts], SCHEMA)


# --- 11 ---------------------------------------------------------------------

def brute_runs(w, min_length, exponent):
    found = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, exponent * q):
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    # a multiple of a run's period gives a stretch inside it
    return sorted(r for r in found if not any(o[2] < r[2] and o[0] <= r[0] and r[0] + r[1] <= o[0] + o[1] for o in found))


def test_runs_of_random_and_periodic_words():
    rng = random.Random(3)
    some = 0
    for trial in range(150):
        kinds, n = rng.randint(1, 4), rng.randint(0, 60)
        w = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            p = rng.randint(1, 9)
            at = rng.randint(0, len(w))
            w[at:at] = ([rng.randrange(kinds) for _ in range(p)] * 9)[:rng.randint(p, 9 * p)]
        for min_length, exponent in ((24, 3), (6, 2), (2, 2), (12, 4)):
            want = brute_runs(w, min_length, exponent)
            assert periodic.runs_of(np.array(w, np.int64), min_length, exponent) == want
            some += len(want)
    assert some > 400


def test_runs_of_strings_with_many_runs():
    a, b = [0], [0, 1]
    for _ in range(12):                          # Fibonacci words hold the most runs
        a, b = b, b + a
    assert periodic.runs_of(np.array(b), 5, 2) == brute_runs(b, 5, 2)
    unary = np.zeros(30_000, np.int64)
    assert periodic.runs_of(unary) == [(0, 30_000, 1)]


def test_ordered_places(monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 3)
    order = random.Random(1).sample(range(200), 200)
    places = periodic.Places(order[0])
    for k, x in enumerate(order[1:], 1):
        have = sorted(order[:k])
        assert places.around(x) == (max([y for y in have if y < x], default=-1), min([y for y in have if y > x], default=-1))
        places.add(x)
        assert list(places) == sorted(order[:k + 1]) and places.size == k + 1


def run_texts():
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(rng.randint(0, 300)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "x " * 24), (104, "x " * 23), (105, "a\x0bb\x1fc " * 30), (106, "é ü " * 40),
             (107, "a b c " * 9 + "q " + "x y " * 20 + "a b c " * 9), (108, "k l m n " * 1000), (None, "z " * 30), (None, None), (107, "x " * 24), (103, "x " * 24)]
    return rows


def expected(i, t):
    w = queries.with_repeats(i, (t or "").encode().split())
    runs = brute_runs(w, 24, 3)
    kept = [x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_periodic_runs_equal_brute_force(spark):
    texts = run_texts()
    found = periodic.periodic_runs(docs_of(spark, texts).repartition(3), rewrite=queries.with_repeats)
    got = collections.Counter(map(tuple, periodic.summary(found).collect()))
    assert got == collections.Counter(expected(i, t) for i, t in texts)
    plain = {r.doc_id: r for r in periodic.periodic_runs(docs_of(spark, texts)).collect()}
    assert [tuple(r) for r in plain[108].runs] == [(0, 4000, 4)] and plain[108].collapsed == "k l m n"
    assert plain[100].collapsed == "" and plain[104].runs == [] and plain[104].n_words == 23
    assert periodic.periodic_runs(docs_of(spark, [])).collect() == []


def test_run_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.op11_kruskal_runs(spark, SF).collect()))
    assert got == sorted(expected(r.doc_id, r.text) for r in rows) and sum(g[1] for g in got) > 5


# --- 12 ---------------------------------------------------------------------

def brute_clusters(rows, k, rounds):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda v: min((gap(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[place(v)[1]].append(v)
        for j, g in groups.items():
            centroids[j] = [sum(c) // len(g) for c in zip(*g)]
    out = [(i, *place(v)[::-1]) for i, v in kept]
    sums = collections.Counter()
    for _, c, d in out:
        sums[c] += d
    return sorted(((i, c, d, sums[c], sum(sums.values()), pivots.digest_of(centroids[c])) for i, c, d in out), key=str)


def vectors(rng, n):
    base = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(base)]) for i in range(n)]
    rows += [(1000 + i, base[0]) for i in range(20)]              # equal vectors: ties
    rows += [(2000, None), (2001, []), (2002, [0.5] * 63), (2003, [0.5] * 65), (2004, [None] + [0.5] * 63), (2005, [math.nan] + [0.5] * 63),
             (2006, [-math.inf] + [0.5] * 63), (2007, [-0.0001] * 64), (2008, [1e5] * 64), (None, [0.25] * 64), (7, rows[7][1]), (7, rows[8][1])]
    return rows


def clustered(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, v string, near int").repartition(4)
    out = pivots.cluster(df, **kw).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", pivots.centroid_digest("centroid"))
    return sorted(map(tuple, out.collect()), key=str)


def test_clusters_equal_brute_force(spark):
    rng = random.Random(4)
    rows = vectors(rng, 200)
    assert clustered(spark, rows) == brute_clusters(rows, 16, 3)
    assert clustered(spark, rows, k=3, rounds=1, n_pivots=2) == brute_clusters(rows, 3, 1)
    few = rows[:5] + rows[200:205]                                 # fewer vectors than centroids, equal centroids
    assert clustered(spark, few) == brute_clusters(few, 16, 3)
    assert clustered(spark, rows[200:220]) == brute_clusters(rows[200:220], 16, 3)
    assert clustered(spark, []) == [] and clustered(spark, [(1, None), (2, [1e300] * 64)]) == []


def test_ptolemaic_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    base = rng.integers(-60, 60, (16, 64))
    points = base[rng.integers(0, 16, 4000)] + rng.integers(-6, 7, (4000, 64))
    chosen = pivots.far_pivots(base, 6)
    ask = pivots.Assigner(base, chosen)
    near = pivots.pivot_distances(points, chosen)
    exact = np.stack([pivots.squared(points, c) for c in base], 1)
    assert (pivots.lower_bounds(near, ask.far, ask.pairs) <= exact).all()
    cluster, distance = ask(points, near)
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert ask.exact < exact.size / 2
    wide = (points + 1) * (1 << 20)                                # bounds stay below at large sizes
    ask = pivots.Assigner(base * (1 << 20), chosen * (1 << 20))
    exact = np.stack([pivots.squared(wide, c) for c in base * (1 << 20)], 1)
    assert (pivots.lower_bounds(pivots.pivot_distances(wide, chosen * (1 << 20)), ask.far, ask.pairs) <= exact).all()


# --- 13 ---------------------------------------------------------------------

@pytest.mark.parametrize("block", [64, 1 << 15])
def test_wavelet_shard_rank_select(monkeypatch, block):
    monkeypatch.setattr(wavelet, "BLOCK_BITS", block)
    rng = np.random.default_rng(5)
    for ids in ([], [0], [0] * 200, [7], rng.integers(0, 9, 1500), rng.zipf(1.3, 700) % 50257, np.r_[np.zeros(300), 50256, np.zeros(300)]):
        ids = np.asarray(ids, np.int64)
        lengths = [len(ids) // 3, len(ids) - len(ids) // 3]
        shard = wavelet.Shard(wavelet.build(ids, [None, 5], lengths, 3, 2, 99) + b"\n")
        assert (shard.decode() == ids).all() and shard.n == len(ids)
        assert (shard.part, shard.number, shard.before, shard.doc_ids, shard.lengths.tolist()) == (3, 2, 99, [None, 5], lengths)
        for i in range(0, len(ids), 37):
            assert shard.access(i) == ids[i]
        for t in {*ids[:20].tolist(), 1, 50256, 70000, -1}:
            assert shard.count(t) == (ids == t).sum() and shard.count(t, len(ids) // 4, len(ids) // 2) == (ids[len(ids) // 4:len(ids) // 2] == t).sum()
            assert shard.occurrences(t).tolist() == np.flatnonzero(ids == t).tolist()
    skewed = np.where(np.arange(1 << 17) % 1000 == 0, 3, 0) if block > 64 else np.zeros(1 << 17, np.int64)
    assert len(wavelet.build(skewed, [1], [len(skewed)])) < len(skewed) // 16   # deflated planes
    with pytest.raises(ValueError):
        wavelet.Shard(b"something else")


AWKWARD = ["", " ", "a", "a b", " a", "a ", "a  b", "a\n\nb", "a\n b", "a \nb", "x\t\ty", "it's 's 's", "\r\n", "end\n\n", "a b", "a  b", "a\x1fb", "a\u0085",
           "<|endoftext|>", "a <|endoftext|> b", "<|endoftext", "日本 語", "é  ü", "1234 56", "!! ?", "\x0ba", "　x", "a​b", "𝔘 x", "a'll b've", "﻿a", "᠎a b"]


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(TOKENIZER), wavelet.Encoder(TOKENIZER)
    rng = random.Random(8)
    pieces = [*AWKWARD, "the", " the", "\n", "word", ".", " ", "\t"]
    texts = AWKWARD + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for t, got in zip(texts, enc([t.encode() for t in texts])):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_keeps_units_across_batches(monkeypatch):
    """Words of every kind in several batches, learned once, also when what is known is given up."""
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(TOKENIZER), random.Random(3)
    letters = ["a", "B", "é", "Ñ", "×", "÷", "ß", "1", "'s", ".", "ā", "Ã", "\u0120", "日"]
    words = ["".join(rng.choices(letters, [9, 9, 4, 4, 1, 1, 4, 1, 1, 1, 1, 1, 1, 1], k=rng.randint(1, 7))) for _ in range(3000)]
    batches = [["x" + rng.choice([" ", "\n"]).join(rng.choices(words, k=60)) + "x" for _ in range(40)] for _ in range(4)]
    want = [[tok.encode(t, add_special_tokens=False).ids for t in b] for b in batches]
    for limit, times in ((1 << 26, 1), (0, 2)):
        monkeypatch.setattr(wavelet, "KNOWN_BYTES", limit)
        enc, asked = wavelet.Encoder(TOKENIZER), []
        cut, learned = enc._cut, enc._words
        enc._cut = lambda part, blank: (asked.extend(part), cut(part, blank))[1]
        enc._words = lambda part: (asked.extend(part), learned(part))[1]
        for b, ids in zip([*batches, *batches], [*want, *want]):
            assert [np.frombuffer(i, "<u4").tolist() for i in enc([t.encode() for t in b])] == ids
        assert (len(asked) == len(set(asked))) == (times == 1)
        assert (enc.keys[1:] > enc.keys[:-1]).all()


def library_rows(rows):
    from tokenizers import Tokenizer

    tok, out, start = Tokenizer.from_file(TOKENIZER), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_shards_round_trip(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i * 7 % 101, " ".join(rng.choice(["alpha", "beta", "gamma,", "x\n"]) for _ in range(rng.randint(0, 80)))) for i in range(101)]
    rows += [(200 + i, t) for i, t in enumerate(AWKWARD)] + [(300, None), (None, "no id"), (None, None), (5, "again"), (5, "again"), (-4, "first"),
                                                             (400, "word " * 30_000)]
    df = docs_of(spark, rows).repartition(5)
    path = f"{tmp_path}/shards"
    wavelet.write_shards(df, path, TOKENIZER, shard_ids=500)
    assert spark.read.format("binaryFile").load(path).count() > 8
    got = sorted(wavelet.read_documents(spark, path).collect(), key=lambda r: r.start)
    want = library_rows(rows)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and [r.start for r in got] == [w[1] for w in want]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    t = tok.token_to_id("Ġalpha")
    ids = [(i, tok.encode(x or "", add_special_tokens=False).ids + [0]) for i, x in rows]
    counts = {r.token: r.n for r in wavelet.token_counts(spark, path, [t, 0, 49999]).collect()}
    assert counts == {k: sum(x.count(k) for _, x in ids) for k in (t, 0, 49999)}
    places = sorted(map(tuple, wavelet.token_places(spark, path, t).collect()), key=str)
    assert places == sorted(((i, k) for i, x in ids for k, y in enumerate(x) if y == t), key=str) and len(places) > 100
    wavelet.write_shards(docs_of(spark, []), f"{tmp_path}/none", TOKENIZER)
    assert wavelet.read_documents(spark, f"{tmp_path}/none").collect() == []


def test_shard_query_equals_library(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op13_wavelet_shards(spark, SF).collect())) == library_rows(rows)


def test_cluster_query_equals_sql_and_brute_force(spark):
    import duckdb

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(map(tuple, queries.op12_ptolemaic_clusters(spark, SF).collect()), key=str)
    assert got == brute_clusters(rows, 16, 3)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(con.execute(queries.ORACLES["op12_ptolemaic_clusters"]()).fetchall(), key=str) == got
