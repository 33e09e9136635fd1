"""The document operators against brute force, on small tables that hold the
awkward cases: nulls, empty and very long texts, ties, repeated rows, extra
columns with clashing names, and empty tables."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codesift.llm import (bpe, components, dialogue, hilbert, minhash, near, packing, paragraphs, positional, quality,
                          queries, repeats, warc)

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, kept string, h string, n string"


def words(rng, n):
    return " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 7))) for _ in range(n))


def corpus():
    """(doc_id, text) with copies, near copies, shared passages and odd rows."""
    rng = random.Random(7)
    passage = words(rng, 60) + ". " + words(rng, 20)
    rows = [(i, words(rng, rng.randint(40, 160)) + (".\n" if i % 3 else " ") + words(rng, 30)) for i in range(30)]
    base = words(rng, 150)
    for k in range(12):
        w = base.split()
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = "xx%d" % k
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, words(rng, 30) + " " + passage + " " + words(rng, 30)) for k in range(6)]
    rows += [(300, None), (301, ""), (302, "one two"), (303, "One\tTWO"), (304, "é" * 99 + "ß" * 99), (305, "a" * 5000),
             (306, words(rng, 20000)), (307, "   \n\t "), (308, "don't <|endoftext|> it's Ünï ½ ２ 日本 é"), (None, base)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][k % 3], "s%d" % (k % 2), k, 5, "k", "h", "n") for k, (i, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def texts():
    return {i: t for i, t in corpus() if i is not None}


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- 1 ----------------------------------------------------------------------

def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        order = np.argsort(hilbert.hilbert_index(grid, bits))
        assert sorted(hilbert.hilbert_index(grid, bits).tolist()) == list(range(side ** dims))
        assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


def test_hilbert_runs_are_even_and_ordered(docs, none, monkeypatch):
    monkeypatch.setattr(hilbert, "PIECE_ROWS", 4)
    sized = lambda d: d.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    for d in (docs, docs.union(docs), docs.limit(3)):
        rows = hilbert.cut_runs(hilbert.hilbert_order(sized(d), hilbert.document_dims(), [F.col("doc_id"), F.col("size")]), 8).collect()
        assert len(rows) == d.count()
        shards = collections.defaultdict(list)
        for r in rows:
            shards[r.shard].append((r.slot, r._curve))
        sizes = [len(shards[s]) for s in range(8)]
        assert max(sizes) - min(sizes) <= 1
        last = -1
        for s in range(8):
            run = sorted(shards[s])
            assert [x for x, _ in run] == list(range(len(run)))
            assert all(a <= b for (_, a), (_, b) in zip(run, run[1:])) and (not run or run[0][1] >= last)
            last = run[-1][1] if run else last
    assert hilbert.cut_runs(hilbert.hilbert_order(sized(none), hilbert.document_dims(), [F.col("doc_id")]), 8).count() == 0


def test_hilbert_order_does_not_depend_on_piece_size(docs, monkeypatch):
    sized = docs.withColumn("size", F.lit(1)).withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))   # one crowded cell
    got = []
    for bound in (4, 7, 50_000):
        monkeypatch.setattr(hilbert, "PIECE_ROWS", bound)
        rows = hilbert.hilbert_order(sized, hilbert.document_dims(sized), [F.col("doc_id"), F.col("text")]).select("doc_id", "text", "_rank").collect()
        got.append(sorted(map(tuple, rows), key=str))
    assert got[0] == got[1] == got[2]


def test_hilbert_shards_prune_on_every_dimension(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice(["de", "en", "es", "fr"]), f"https://site{rng.randrange(40):02d}.example", 2 ** rng.randint(4, 14)) for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, size bigint")

    def read(dims):
        """Shards whose value range meets a filter, over all filters of a kind."""
        run = hilbert.cut_runs(hilbert.hilbert_order(d, dims, [F.col("doc_id")]), 32)
        spans = run.groupBy("shard").agg(*[f(c).alias(f"{n}_{c}") for c in ("lang", "source", "size") for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        meets = lambda c, v: sum(s[f"lo_{c}"] <= v <= s[f"hi_{c}"] for s in spans)
        return [np.mean([meets(c, v) for v in sorted({r[k] for r in rows})]) for k, c in ((1, "lang"), (2, "source"), (3, "size"))]

    ranked, hashed = read(hilbert.document_dims(d)), read(hilbert.document_dims())
    assert all(x < 24 for x in ranked) and ranked[0] < hashed[0] and ranked[1] < hashed[1] / 2, (ranked, hashed)
    hilbert.write_shards(hilbert.cut_runs(hilbert.hilbert_order(d, hilbert.document_dims(d), [F.col("doc_id")]), 4), f"{tmp_path}/s", tasks=12)
    files = spark.read.parquet(f"{tmp_path}/s").groupBy("shard", F.input_file_name().alias("f")).agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("n")).collect()
    assert len(files) > 8 and all(r.b - r.a + 1 == r.n for r in files)


def test_hilbert_query_columns(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op1_hilbert_sharding(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(rows) == len(docs)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and set(slots) == set(range(8))


# --- 2 ----------------------------------------------------------------------

def brute_repeats(texts, length):
    seen, out = {}, {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p:p + length] in seen:
                cover[p:p + length] = True
            else:
                seen[b[p:p + length]] = 1
        out[i] = (len(b), int(cover.sum()), int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum()),
                  hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest())
    return out


@pytest.mark.parametrize("group", [20_000, 2])
def test_repeats_equal_brute_force(docs, texts, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()
           if r.doc_id is not None}
    assert got == brute_repeats(texts, 100)


def test_repeats_across_slices(docs, texts, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 700)
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs).collect() if r.doc_id is not None}
    assert got == {i: v[1] for i, v in brute_repeats(texts, 100).items()}


def test_repeats_of_repeated_rows_and_empty(spark, none):
    t = words(random.Random(1), 80)
    rows = repeats.remove_repeats(spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (1, 0), (2, len(t))]
    assert repeats.remove_repeats(none).count() == 0 and repeats.without_repeats(none).columns == none.columns


def test_longest_previous_factor_array():
    s = b"abracadabra abracadabra"
    order = sorted(range(len(s)), key=lambda i: s[i:])
    common = lambda a, b: next((k for k in range(len(s)) if s[a + k:a + k + 1] != s[b + k:b + k + 1] or a + k >= len(s)), 0)
    lcp = np.array([0] + [common(a, b) for a, b in zip(order, order[1:])])
    got = repeats.longest_previous_factors(np.array(order), lcp)
    for i, f in zip(order, got):
        assert f == max([common(i, j) for j in range(i)], default=0)


# --- 3, 6 ---------------------------------------------------------------------

def shingle_set(text, k=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(sets, percent=80):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates_equal_brute_force(docs, texts, none):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    rows = near.near_duplicates(docs).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is not None}
    comp = brute_components(sets)
    assert got == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}
    assert near.near_duplicates(none).count() == 0
    assert near.drop_near_duplicates(docs).columns == docs.columns


def test_large_bucket_blocks_find_all_links(spark, monkeypatch):
    """A hot group whose stars miss links: copies at growing distance."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(5)
    base = words(rng, 200).split()
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(200)] = "z%d" % rng.randrange(10**6)
        rows.append((k, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_components({i: shingle_set(t) for i, t in rows})


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.r_[a[:900], rng.integers(0, 2**63, 100).astype(np.uint64)]
    s = minhash.samples_of(np.r_[a, b], np.array([0, 1000]), 240)
    odd = minhash.odd_sketches(s, 1024)
    z = int(np.bitwise_count(odd[0] ^ odd[1]).sum())
    estimate = 1 + 1024 / (4 * 240) * np.log(1 - 2 * z / 1024)
    assert abs(estimate - 900 / 1100) < 0.1


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 120)] + [(7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 120)}


def test_paragraphs_equal_brute_force(docs, texts, none):
    units = {}
    for i, t in texts.items():
        for number, w in enumerate(own_paragraphs(t)):
            units[i, number] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    comp = brute_components(units)
    want = {(d, n): comp[d, n] for d, n in units if comp[d, n] != (d, n)}
    got = {(r.doc_id, r.paragraph): (r.kept_doc_id, r.kept_paragraph) for r in paragraphs.repeated_paragraphs(docs).collect()}
    assert got == want and len(got) > 5
    assert paragraphs.repeated_paragraphs(none).count() == 0


def own_paragraphs(text):
    """Paragraph word lists, cut from lines and sentences by other means."""
    out = []
    for line in (text or "").split("\n"):
        sentences = [x.lower().split() for x in re.split(r"(?<=[.!?])(?=[ \t\r\x0b\x0c])", line)]
        for long, run in itertools.groupby(sentences, lambda x: len(x) >= 8):
            out += list(run) if long else [sum(run, [])]
    return [w for w in out if w]


def test_short_paragraphs_and_cuts_equal_brute_force(spark):
    ten = "alpha beta gamma delta epsilon zeta eta theta iota kappa."
    rows = [(1, f"Six words stand before this one. {ten} Short end."), (2, f"Others. Here. {ten}\nsee also page six"),
            (3, f"{ten}\nSee also  PAGE six\n\n"), (4, "x\ny z\nno ending but more than eight words in here"), (5, "x"), (6, None), (7, " \n"),
            (8, "Aside. no ending but more than eight words in here"), (9, "six words and no stop here"), (10, "a\nsix words and no stop here\n")]
    got = {(r.doc_id, r.paragraph): (r.kept_doc_id, r.kept_paragraph, r.n_words)
           for r in paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    units = {(i, n): w for i, t in rows for n, w in enumerate(own_paragraphs(t))}
    sets = {u: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for u, w in units.items()}
    comp = brute_components(sets)
    assert got == {u: (*comp[u], len(units[u])) for u in units if comp[u] != u}
    assert {(2, 1), (3, 0), (3, 1), (5, 0), (8, 1), (10, 1)} == set(got)


def test_paragraph_join_misses_no_pair(spark):
    """1,500 pairs at the threshold and just above, each with no other link."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    rows = []
    for k in range(1500):
        base = [word() for _ in range(rng.choice([13, 22, 40]))]     # 9, 18, 36 shingles
        more = base + [word() for _ in range((len(base) - 4) // 4)]   # 11, 22, 45: similarity 0.8 and above
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(more))]
    assert all(100 * len(shingle_set(a, 5)) >= 80 * len(shingle_set(b, 5)) for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    got = {(r.doc_id, r.kept_doc_id) for r in paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(2 * k + 1, 2 * k) for k in range(1500)}


def test_paragraph_bands_measured_recall():
    """Sets of similarity 0.8: bands that miss one in 100,000 miss at most two of 20,000."""
    rng = np.random.default_rng(12)
    p = paragraphs.PARAGRAPHS
    assert p.recall(0.8) > 0.99999
    missed = 0
    for m in (9, 36, 144):
        both = rng.integers(0, 2**63, (6667, 10 * m // 8 + 1)).astype(np.uint64) * np.uint64(2)
        a, b = both[:, :m - m % 4], both[:, :5 * (m // 4)]           # a is in b, four fifths of it
        keys = [p.keys(x.ravel(), np.arange(0, x.size, x.shape[1]))[0].reshape(len(x), p.bands) for x in (a, b)]
        missed += int((keys[0] != keys[1]).all(1).sum())
    assert missed <= 2


def test_paragraph_bands_equal_exact_prefixes(docs):
    found = [sorted(map(tuple, paragraphs.repeated_paragraphs(docs, scheme=s).collect()), key=str)
             for s in (paragraphs.PARAGRAPHS, minhash.Prefixes(5, 80, 256))]
    assert found[0] == found[1] and len(found[0]) > 5


def test_prefixes_and_parities_are_bounds():
    rng = np.random.default_rng(4)
    p = minhash.Prefixes(5, 80, 256)
    for m in (1, 4, 5, 9, 100, 3000):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, m).astype(np.uint64) * np.uint64(2))
            lack = rng.choice(len(a), len(a) // 5, replace=False)
            b = np.unique(np.delete(a, lack))
            keys, n = p.keys(np.r_[a, a[:1], b], np.array([0, len(a) + 1]))
            assert n.tolist() == [len(a) // 5 + 1, len(b) // 5 + 1] and set(keys[:n[0]]) & set(keys[n[0]:])
            odd = p.sketch(np.r_[a, b], np.array([0, len(a)]))
            assert np.bitwise_count(odd[0] ^ odd[1]).sum() <= len(lack) <= p.most_odd_bits(len(a) + len(b))


def test_band_tuning():
    s = minhash.tuned(5, 80, 0.999, 40, 128, 256)
    assert s.recall(0.8) >= 0.999 and s.bands <= 40
    with pytest.raises(ValueError):
        minhash.tuned(5, 80, 0.999, 1, 128, 256)


# --- 4 ----------------------------------------------------------------------

def test_warc_round_trip_with_magic_in_payloads(spark):
    fake = "x" + warc.MAGIC + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "u", "hello"), (2, None, None), (3, "u\r\nv", fake * 40), (4, "u", "hello"), (5, "u", warc.MAGIC),
             (6, "u", "é\r\n\r\n" * 50), (7, "u", ""), (8, "u", fake), (9, "u", "y" * 100000), (10, "u", warc.MAGIC * 30)]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id bigint, url string, html string, kept string").coalesce(1)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "700", "4000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
            first, want = {}, {}
            for i, _, h in pages:
                b = (h or "").encode()
                d = base64.b32encode(hashlib.sha1(b).digest()).decode()
                f = first.setdefault(d, i)
                want[i] = (len(b), d, "response" if f == i else "revisit", None if f == i else f)
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("marks", [1 << 25, 64])
def test_warc_copies_are_revisit_records(spark, tmp_path, marks, monkeypatch):
    monkeypatch.setattr(warc, "MARKS", marks)
    body = "payload " * 50
    pages = [(9, "a", body), (4, "b", body), (7, "c\r\nWARC-Type: x", body), (10, "d", body), (None, "e", body), (4, "f", "other"), (5, "g", None),
             (6, "h", ""), (8, "i", "other" + warc.MAGIC)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(2)
    warc.write_archives(df, str(tmp_path / "w"))
    raw = b"".join(f.read_bytes() for f in (tmp_path / "w").glob("part-*"))
    assert raw.count(body.encode()) == 2 and raw.count(b"\r\nWARC-Refers-To: <urn:page:4>\r\n") == 3
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    got = {(r.record_id, r.uri): (r.type, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    first = {9: 4, 7: 4, 10: 4, 6: 5}
    assert got == {(f"<urn:page:{'' if i is None else i}>", u.replace("\r\n", "  ")):
                   ("revisit" if i in first else "response", len(h or ""), digest(h or ""), f"<urn:page:{first[i]}>" if i in first else None)
                   for i, u, h in pages}
    assert warc.stated_payload({b"warc-payload-digest": b"sha1:" + digest("x").lower().encode()}) == (digest("x"), None)


# --- 5 ----------------------------------------------------------------------

def test_quality_measures_and_limits(spark, docs, texts, none):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for i, r in by_id(quality.score(docs).filter("doc_id is not null")).items():
        t = texts[i] or ""
        w = word.findall(t)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {p for k in range(len(w) - 2) if tri[tuple(w[k:k + 3])] > 1 for p in range(k, k + 3)}
        lines = [x for x in t.split("\n") if word.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality.score(none).count() == 0 and quality.filter_quality(none).columns == none.columns
    rng = random.Random(2)
    many = [(i, words(rng, 80) if i % 10 else " ".join(x + "###" for x in words(rng, 80).split()), "en", "s") for i in range(400)]
    kept = {r.doc_id for r in quality.filter_quality(spark.createDataFrame(many, "doc_id bigint, text string, lang string, source string")).collect()}
    assert kept == {i for i in range(400) if i % 10}


def brute_verdicts(rows):
    """doc_id -> kept, from rows of ``score``: limits by sorting, no sketches merged by counts."""
    rules = {"symbols": lambda r: r.n_symbols * 1000 // max(r.n_words, 1), "dup_lines": lambda r: r.n_dup_lines * 1000 // max(r.n_lines, 1),
             "repeats": lambda r: r.n_repeat_words * 1000 // max(r.n_words, 1), "word_length": lambda r: r.word_chars * 100 // max(r.n_words, 1)}

    def least(v):                                # least value of v's bucket
        return v if v < 64 else v >> (v.bit_length() - 5) << (v.bit_length() - 5)

    def fence(group, rule):
        vs = sorted(least(rules[rule](r)) for r in group)
        if not vs:
            return 0, None, None
        at = lambda a, b: vs[-(-len(vs) * a // b) - 1]
        least_spread, _ = quality.RULES[rule]
        spread = max(at(3, 4) - at(1, 4), at(9, 10) - at(1, 2) if rule == "repeats" else 0, least_spread)
        return len(vs), at(1, 4) - 3 * spread, at(3, 4) + 3 * spread

    passed = [r for r in rows if not r.base_failed]
    kept = {}
    for r in rows:
        ok = not r.base_failed
        for rule, value in rules.items():
            lo, hi = None, None
            for wider in (passed, [x for x in passed if x.lang == r.lang], [x for x in passed if (x.lang, x.source) == (r.lang, r.source)]):
                n, a, b = fence(wider, rule)
                if n:
                    lo, hi = (a, b) if lo is None else ((n * a + quality.PRIOR * lo) // (n + quality.PRIOR), (n * b + quality.PRIOR * hi) // (n + quality.PRIOR))
            ok = ok and (hi is None or value(r) <= hi) and (rule != "word_length" or lo is None or value(r) >= lo)
        kept[r.doc_id] = ok
    return kept


def test_quality_verdicts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = docs.filter("doc_id % 7 = 0").selectExpr("doc_id + 1000000 as doc_id", "concat(text, ' ', repeat(concat(substr(text, 1, 60), '\n'), 3)) as text", "lang", "null as source", "n_chars")
    both = docs.unionByName(more)
    rows = quality.score(both).collect()
    want = brute_verdicts(rows)
    assert {r.doc_id: r.kept for r in rows} == want
    failed = sum(not r.base_failed and not want[r.doc_id] for r in rows)
    assert failed > 5
    assert sorted(r.doc_id for r in quality.filter_quality(both).collect()) == sorted(i for i, k in want.items() if k)
    got = {r.doc_id: r.kept for r in queries.op5_adaptive_quality(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute_verdicts(quality.score(docs).collect())


def test_quantile_sketch_buckets(spark):
    df = spark.range(0, 5000).withColumn("_bucket", F.expr(quality.bucket("id")).cast("long"))
    for r in df.select("id", "_bucket", quality.bucket_value(F.col("_bucket")).alias("v")).collect():
        assert r.v <= r.id <= r.v * 17 / 16 + 1


# --- 7 ----------------------------------------------------------------------

def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob b", None), (1, 3, None, "who"), (1, 3, None, "who"),
            (1, None, "ann", "early"), (2, 0, "system", "alone"), (None, 0, "ann", "lost")] + [(3, k, f"p{k % 3}", "t" * k) for k in range(1100)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, block string")
    got = collections.defaultdict(list)
    for r in dialogue.rotate(df).collect():
        got[r.conv_id, r.perspective].append(r)
    assert set(got) == {(1, "ann"), (1, "bob b"), (3, "p0"), (3, "p1"), (3, "p2")}
    for (conv, who), turns in got.items():
        turns.sort(key=lambda r: r.char_start)
        assert len(turns) == (6 if conv == 1 else 1100)
        whole = "".join(r.segment for r in turns)
        for r in turns:
            assert whole[r.char_start:r.char_end] == r.segment and r.is_target == (r.speaker == who)
            assert (r.role == "assistant") == r.is_target and (r.loss_start is None) != r.is_target
            if r.is_target:
                assert whole[r.loss_start:r.loss_end].endswith(dialogue.END)
    ann = sorted(got[1, "ann"], key=lambda r: r.char_start)
    assert [r.role for r in ann] == ["assistant", "system", "assistant", "user", "user", "user"]
    assert ann[3].name == "bob_b" and ann[2].segment.count(dialogue.END) == 1
    assert dialogue.rotate(df.limit(0)).count() == 0


def test_speakers_have_names_of_their_own(spark):
    speakers = ["bob b", "bob_b", "bob  b", "bob\\_b", "bob\tb", "bob\nb", "bob\\nb", "<|x", "< |x", "<\\|x", "", "_", " ", "Bob b"]
    df = spark.createDataFrame([(1, k, s, "t") for k, s in enumerate(speakers)], "conv_id bigint, turn bigint, role string, text string")
    names = {r.speaker: r.name for r in dialogue.rotate(df).filter("perspective != speaker").collect()}
    assert set(names) == set(speakers) and len(set(names.values())) == len(speakers)
    assert not any(re.search(r"\s", n) or "<|" in n for n in names.values())


# --- 8, 10 --------------------------------------------------------------------

@pytest.fixture(scope="module")
def token_ids():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(TOKENIZER)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def test_packing(docs, texts, none, token_ids):
    rows = [r for r in packing.pack(docs, TOKENIZER).collect()]
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert {i for i in pieces if i is not None} == set(texts)
    for i, t in texts.items():
        ids, at = np.array(token_ids(t) + [1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    total = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
    assert len(sequences) - total / 2048 < 2
    assert packing.pack(none, TOKENIZER).count() == 0
    assert packing.pack(docs.union(docs), TOKENIZER).count() == 2 * len(rows)


def test_differencing_raises_the_window_count():
    sizes = np.array([1500, 1500, 1500, 300, 300])      # three windows by the sum, but no window holds two large items
    of = packing.pack_group(sizes, 2000)
    assert np.bincount(of, sizes).max() <= 2000 and of.max() + 1 == 3
    assert packing.pack_group(np.array([1500] * 4), 2000).max() + 1 == 4


def test_token_counts(docs, texts, none, token_ids):
    for i, r in by_id(bpe.count_tokens(docs, TOKENIZER).filter("doc_id is not null")).items():
        n = len(token_ids(texts[i]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[i] or "").encode()), n, n > 2048)
    assert bpe.count_tokens(none, TOKENIZER).count() == 0


def test_encoders_on_odd_texts(token_ids):
    rng = random.Random(3)
    letters = list("abcdeSTREVLMD'''  .,!?019\n\t-_<|>éÈßÿ×÷ñ²½ªµ\xa0İΣσ日x́’\x1c\x85😀") + ["'s", "'re", "<|endoftext|>", "don't"]
    texts = ["".join(rng.choice(letters if i % 3 else letters[:26]) for _ in range(rng.randint(0, 50))) for i in range(3000)]
    raw = [t.encode() for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.Encoder(TOKENIZER)(raw)] == [token_ids(t) for t in texts]
    assert bpe.TokenCounter(TOKENIZER)(raw).tolist() == [len(token_ids(t)) for t in texts]


# --- 9 ----------------------------------------------------------------------

def brute_hits(text, items):
    find = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: find.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    w, hit, found = low(text), set(), set()
    for i, t in items:
        v = low(t)
        for k in range(max(1, len(v) - 9) if v else 0):
            win = v[k:k + 10]
            for p in range(len(w) - len(win) + 1):
                if w[p:p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("pass_bytes", [8 << 20, 10])
def test_decontamination_equals_brute_force(spark, docs, texts, none, pass_bytes, monkeypatch):
    monkeypatch.setattr(positional.passes, "__defaults__", (pass_bytes,))
    items = [(1, " ".join(texts[3].split()[5:30])), (2, texts[7].upper()[:200]), (3, "one TWO"), (4, None), (5, ""), (6, "absent words"),
             (20, " ".join(texts[3].split()[5:30])), (7, "; ".join(texts[100].split()[:14]))]
    bench = spark.createDataFrame([(*x, "k") for x in items], "item_id bigint, text string, items string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in positional.decontaminate(docs, bench).collect() if r.doc_id is not None}
    for i, t in texts.items():
        if i != 306:
            assert got[i] == brute_hits(t, items), i
    assert positional.decontaminate(none, bench).count() == 0
    assert positional.decontaminate(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert {r.doc_id for r in positional.clean(docs, bench).collect() if r.doc_id is not None} == {i for i in got if not got[i][1]}


def test_proximity_matches():
    seg = positional.Segment([b"a", b"b", b"c"], np.array([2, 4, 5]), np.array([0, 6, 2, 7, 4]))
    block = positional.Phrases([[b"a", b"b"], [b"b", b"zz"]])
    assert [x.tolist() for x in block.find(seg)] == [[0], [6]]
    assert [x.tolist() for x in block.find(seg, slop=1)] == [[0, 0], [0, 6]]


def test_proximity_stays_inside_documents(spark):
    texts = {1: "foo alpha", 2: "beta bar", 3: "alpha x beta", 4: "beta alpha", 5: "x alpha", 6: "alpha beta gamma beta", 7: "alpha x x beta"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame([("i", "alpha beta"), ("j", "gamma beta alpha")], "item_id string, text string")
    found = {}
    for slop in (0, 1, 2):
        for r in positional.search(positional.build_index(docs), items, slop=slop).collect():
            found[slop, r.doc_id] = r["items"]

    def near_in(t, phrase, slop):
        """From an occurrence of the rarest term, every other term within slop of its place."""
        w = t.split()
        counts = collections.Counter(x for y in texts.values() for x in y.split())
        k = min(range(len(phrase)), key=lambda i: (counts[phrase[i]], i))
        return any(all(any(w[q] == x and abs(q - (p - k + i)) <= slop for q in range(len(w))) for i, x in enumerate(phrase)) for p in range(len(w)) if w[p] == phrase[k])

    for (slop, d), got in found.items():
        want = [name for name, ph in (("i", ["alpha", "beta"]), ("j", ["gamma", "beta", "alpha"])) if near_in(texts[d], ph, slop)]
        assert got == want, (slop, d)
    assert found[0, 1] == found[1, 1] == found[2, 2] == [] and found[1, 3] == ["i"]


def test_long_words_merge_like_short_ones():
    merger, rng = bpe.RankMerger(TOKENIZER), random.Random(4)
    words_ = ["".join(rng.choice(s) for _ in range(n)).encode() for s in ("acgt", "a", "ab", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz!é") for n in (1, 2, 3, 40, 700)]
    flat, counts = merger.symbols(words_)
    ends = np.cumsum(counts)
    for w, a, b in zip(words_, ends - counts, ends):
        assert merger.linked_symbols(w) == flat[a:b].tolist()
    long = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    from tokenizers import Tokenizer
    assert merger.counts([b"ab", long]).tolist()[1] == len(Tokenizer.from_file(TOKENIZER).encode(long.decode(), add_special_tokens=False).ids)


def test_pipeline_judges_near_duplicates_by_five_words(spark):
    import corpus_pipeline
    base = ["w%d" % k for k in range(150)]
    other = [("x%d" % k if k in (20, 50, 80, 110) else w) for k, w in enumerate(base)]
    copy = [("y%d" % k if k == 60 else w) for k, w in enumerate(base)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(copy))], "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 2}    # 1, 2: 126 of 166 shingles
    assert {r.doc_id for r in near.drop_near_duplicates(docs).collect()} == {1}                        # of four words: 131 of 163


# --- driver queries ------------------------------------------------------------

def test_pipeline_stages_and_queries(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.schema == docs.schema
        assert 0 < out.count() <= docs.count()
        docs = corpus_pipeline.written(out, "test")
    want = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} == want
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
