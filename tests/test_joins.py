"""Candidate generation of the similarity joins against brute force, the
store writer's files, and the pruning of the corpus listing."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from codesift.operators import clones as CL
from codesift.operators import report as R
from codesift.operators import symbols as SY
from codesift.sources import files as SF
from codesift.sources import vulnstore as VS

LINES = ["", "}", "return0;"] + [f"l{i}" for i in range(12)]


@pytest.fixture(scope="module")
def sets(spark):
    rnd = random.Random(5)
    fns = [(f"f{i}", ["", "}"] + rnd.choices(LINES, k=rnd.randint(0, 12))) for i in range(60)] + [("none", [])]
    bodies = [(f"v{i}", rnd.choices(LINES, k=rnd.randint(0, 9))) for i in range(25)] + [("hot", ["", "}"])]
    return fns, bodies


@pytest.mark.parametrize("theta, limit", [(0.0, None), (0.5, None), (0.7, 1), (1.0, None)])
def test_containment_and_jaccard_match_brute_force(spark, monkeypatch, sets, theta, limit):
    if limit is not None:
        monkeypatch.setattr(CL, "BROADCAST_BYTES", limit)   # the salted joins
    fns, bodies = sets
    f = spark.createDataFrame(fns, "func_id string, norm array<string>")
    b = spark.createDataFrame([(v, "vul", ls) for v, ls in bodies], "vuln_idx string, which string, body array<string>")
    got = {(r.func_id, r.vuln_idx, r.shared) for r in CL.containment_pairs(f, b, theta, min_lines=2).collect()}
    pairs = [(x, y, set(p), set(q), q) for (x, p), (y, q) in itertools.product(fns, bodies) if set(p) & set(q)]
    assert got == {(x, y, len(p & q)) for x, y, p, q, _ in pairs if len(q) >= 2 and len(p & q) / len(q) >= theta}
    a = f.select(F.col("func_id").alias("a_id"), F.col("norm").alias("lines"))
    bb = b.select(F.col("vuln_idx").alias("b_id"), F.col("body").alias("lines"))
    got = {(r.a_id, r.b_id, r.inter) for r in CL.jaccard_pairs(a, bb, theta).collect()}
    assert got == {(x, y, len(p & q)) for x, y, p, q, ls in pairs
                   if len(p & q) / (len(p) + len(ls) - len(p & q)) >= theta}


def test_lcs_join_matches_all_pairs(spark):
    rnd = random.Random(3)
    texts = sorted({"".join(rnd.choices("abc(.", k=rnd.randint(0, 12))) for _ in range(60)})
    pats = ["abc(", "a.b(c", "", "cab(.abc", "b"]
    got = {(r.text, r.pattern) for r in SY.lcs_join(
        spark.createDataFrame([(t,) for t in texts], "text string"),
        spark.createDataFrame([(p,) for p in pats], "pattern string"), 0.7).collect()}
    assert got == {(t, p) for t in texts for p in pats
                   if t and p and SY.lcs_length_bits(t, p) / max(len(t), len(p)) >= 0.7}


def test_store_files_round_trip(spark, tmp_path):
    q = 'say("a\\n") é'
    store = {
        "oss_idx": spark.createDataFrame([("o", "A"), ("o", "B")], "oss string, vuln_idx string"),
        "vuln_cve": spark.createDataFrame([("A", "CVE-1")], "vuln_idx string, cve string"),
        "vuln_hash": spark.createDataFrame([("o", "h1"), ("o", "h2")], "oss string, hash string"),
        "vuln_body": spark.createDataFrame([("A", [q, ""], None), ("B", ["x"], ["y"])],
                                           "vuln_idx string, vul_body array<string>, old_body array<string>"),
        "ess_lines": spark.createDataFrame([("A", "common", q, "z"), ("A", "minus", "m", "m"), ("B", "minus", "n", "n")],
                                           "vuln_idx string, kind string, vul_body string, abs_body string"),
        "pat_lines": spark.createDataFrame([("B", "p", "pa")], "vuln_idx string, pat_body string, abs_body string"),
        "dep_lines": spark.createDataFrame([("A", "vul", "k", "a1", "o1"), ("A", "old", "k", "a2", "o2"),
                                            ("B", "vul", "k", "a3", "o3")],
                                           "vuln_idx string, origin string, dep_key string, abs_norm_vul string, "
                                           "orig_norm_vul string")}
    VS.write_vuln_store(store, str(tmp_path / "s"))
    again = VS.load_vuln_store(spark, str(tmp_path / "s"))
    for name, df in store.items():
        assert sorted(map(str, again[name].select(*df.columns).collect())) == sorted(map(str, df.collect())), name
    assert (tmp_path / "s" / "vulDEPLines" / "A_depen.txt").exists()
    assert (tmp_path / "s" / "noOldDEPLines" / "B_depen.txt").exists()
    assert json.loads((tmp_path / "s" / "vulESSLines" / "A_common.txt").read_text()) == [{"vul_body": q, "abs_body": "z"}]


def test_corpus_listing_is_pruned(spark, tmp_path):
    root = tmp_path / "r"
    for rel, n in (("src/a b.c", 3), ("src/b.py", 3), ("vendor/c.c", 3), ("src/big.c", 500)):
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text("x" * n)
    df = SF.scan_corpus(spark, str(root), max_bytes=100, exclude=["vendor"], suffixes=[".c"])
    assert [r.path for r in df.collect()] == ["src/a b.c"]
    plan = df._jdf.queryExecution().executedPlan()
    while plan.nodeName() != "Scan binaryFile ":
        plan = plan.children().head()
    assert plan.metrics().apply("numFiles").value() == 1    # the others are never opened


def test_go_summary_in_one_pass(spark):
    rows = [("a", "high", "X"), ("a", "low", "X"), ("b", "high", "Y"), ("b", "odd", None)]
    r = R.go_summary(spark.createDataFrame(rows, "path string, severity string, name string")).first()
    assert (r.total_files, r.high, r.medium, r.low) == (2, 2, 0, 1)
    assert r.vulnerabilities == {"X": 2, "Y": 1}
    empty = R.go_summary(spark.createDataFrame([], "path string, severity string, name string")).first()
    assert (empty.total_files, empty.high, empty.vulnerabilities) == (0, 0, {})
