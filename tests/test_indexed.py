"""The literal-factor index: factors of patterns, and D2, D3, D4 through it
against the unrolled form and against Python's regex engine."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codesift.functions import factors
from codesift.functions.regex import check_pattern, with_reasons
from codesift.operators import detect as D
from codesift.operators import indexed
from codesift.sources import catalog as CAT

MORE = [r"os\.system\s*\(", r"(?:password|passwd|pwd_)\s*=\s*[\"']", r"a{2,}bcd", r"x?yzw", r"(abc)+def", r"(abc)*def", r"\bexec\b", r"[a-z]{3}",
        r"(?i)SELECT\s+\*", r"foo(?!bar)baz", r"(?=look)look", r"a|bcd", r"abc|bcd|cde", r"line1\nline2", r"é\w+abc", r"\d+", r"Kelvin", r"(?i:kisses)x",
        r"(?i:tube)x", r"eval\((?:a|b)\)", r"begin[\s\S]*?end", r"tab\tnext", r"(?P<q>['\"])abc(?P=q)", r"ABC", r"abc", "a\\.b\\.c", r"(?:ab|cd){2}", r"x{0}abc"]
PIECES = ["os.system (", "password = '", "passwd=\"", "aabcd", "yzw", "xyzw", "abcabcdef", "def", "exec", "select  *", "SELECT *", "foobaz", "foobarbaz", "look",
          "bcd", "cde", "line1", "line2", "éxabc", "42", "Kelvin", "Kelvin", "kiſſesx", "KISSESx", "TUBEx", "eval(a)", "begin", "end", "tab\tnext", "'abc'",
          "'abc\"", "ABC", "abc", "a.b.c", "abcd", "cdab", "\n", "\n", " ", " ", "日本", "\r"]


def test_required_clauses():
    want = {r"os\.system\s*\(": {"os.system"}, r"(?:password|passwd|pwd_)=": {"assword", "asswd", "wd_"}, r"a|bcd": None, r"(abc)*def": {"def"},
            r"(abc)+x": {"abc"}, r"[a-z]{3}": None, r"(?i)skip": None, r"(?i)tube": {"tube"}, r"(?i:tube)xyz": {"tube", "xyz"}, r"x{0}ab": None, r"a(": None}
    for pattern, literals in want.items():
        found = factors.required_clauses(pattern)
        assert (set().union(*found) if found else None) == literals, pattern


def test_keys_are_in_every_match():
    rng = random.Random(1)
    for p, f in zip(MORE, factors.index_keys(MORE)):
        for _ in range(300):
            t = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 8)))
            if re.search(p, t):
                assert not f.keys or any(k in factors._lower(t) for k in f.keys), (p, t)
                assert f.literal in t


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    rows = [(f"d/f{i}.{rng.choice(['py', 'js', 'txt'])}", "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [("d/empty.py", ""), ("d/null.py", None), ("d/long.py", "- -\n" * 20_000 + "os.system (a)\n")]
    return spark.createDataFrame(rows, "path string, content string").repartition(3).persist()


def catalogue(patterns, per=2):
    return [(f"S{i}", f"n{i}", "high", "d", patterns[i:i + per]) for i in range(0, len(patterns), per)]


def both(monkeypatch, run):
    out = []
    for bound in (10 ** 6, 0):
        monkeypatch.setattr(D, "MAX_UNROLLED", bound)
        out.append(sorted(map(tuple, run().collect()), key=str))
    assert out[0] == out[1]
    return out[0]


def test_indexed_equals_unrolled(spark, texts, monkeypatch):
    builtin = [p for cat in (CAT.PYTHON_CATALOG, CAT.JAVASCRIPT_CATALOG) for *_, ps in cat for p in ps]
    cat = catalogue(MORE + builtin + ["a(", "", "x*"])
    assert len(both(monkeypatch, lambda: D.detect_all(texts, cat, "P", "t", 0.0))) > 100
    lines = texts.select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "text"))
    assert len(both(monkeypatch, lambda: D.detect_lines(lines, cat, "G-py", "t", keep_non_re2=True))) > 100
    sigs = [{"sig_id": s, "name": n, "severity": v, "affected_languages": [["python"], ["python", "javascript"]][k % 2], "code_patterns": ps}
            for k, (s, n, v, _, ps) in enumerate(cat)]
    assert len(both(monkeypatch, lambda: D.detect_first(texts, sigs))) > 100
    monkeypatch.setattr(indexed, "INDEX_BYTES", 2000)                    # a catalogue taken in parts
    assert len(indexed.parts([("x" * 50,)] * 100)) > 2
    whole = D.detect_all(texts, cat, "G-vul", "t", 0.0).count()
    monkeypatch.setattr(indexed, "INDEX_BYTES", 1 << 20)
    assert D.detect_all(texts, cat, "G-vul", "t", 0.0).count() == whole > 100


def test_five_thousand_patterns_in_one_read(spark, tmp_path):
    rng = random.Random(3)
    patterns = MORE[:6] + [rf"func{i}\s*\(" for i in range(5000)]
    rows = [(f"d/g{i}.py", "\n".join(f"func{rng.randrange(9000)} ({i})" + rng.choice(PIECES) for _ in range(20))) for i in range(40)]
    spark.createDataFrame(rows, "path string, content string").write.parquet(f"{tmp_path}/t")
    files = spark.read.parquet(f"{tmp_path}/t")
    engines = [re.compile(p, re.ASCII) for p in patterns]
    found = D.detect_all(files, catalogue(patterns, 1), "G-vul", "t", 0.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange hashpartitioning" not in plan
    got = sorted((r.path, r.sig_id, r.matched_code, r.line_start) for r in found.collect())
    want = sorted((path, f"S{i}", m.group(), t[:m.start()].count("\n") + 1) for path, t in rows
                  for i, p in enumerate(engines) for m in p.finditer(t))
    assert got == want and len(got) > 400
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "text"))
    hits = D.detect_lines(lines, catalogue(patterns, 1), "G-py", "t")
    assert hits._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    want = sorted((path, f"S{i}", n) for path, t in rows for n, line in enumerate(t.split("\n"))
                  for i, p in enumerate(engines) if p.search(line))
    assert sorted((r.path, r.sig_id, r.line_start) for r in hits.collect()) == want


def test_reasons_equal_single_checks(spark):
    ps = MORE + ["a(", "[a", "x*", "", None, "(?=os)", "(?<!x)a*", "a|", "^", "$", r"\b", "(?=os)os", "a{2", "x?"]
    rows = with_reasons(spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, pattern string"), "python").collect()
    for r in rows:
        want = check_pattern(spark, r.pattern, "python")
        assert (r.reason or "")[:8] == (want or "")[:8], r.pattern
    many = spark.range(150_000).selectExpr("concat('p', id) as pattern", "'k' as other")
    ok, bad = CAT.validate_patterns(many)
    assert ok.count() == 150_000 and bad.count() == 0 and ok.columns == ["pattern", "other"]


def test_keys_of_a_large_catalogue_lead_to_few_patterns():
    patterns = [rf"os\.system\s*\(\s*cmd{k}\)" for k in range(20_000)]
    users = {}
    for f in factors.index_keys(patterns):
        for key in f.keys:
            users[key] = users.get(key, 0) + 1
    assert max(users.values()) <= 20


def test_shuffled_index_equals_broadcast_one(spark, texts, monkeypatch):
    cat = catalogue(MORE + [rf"func{i}\s*\(" for i in range(600)])
    run = lambda: sorted(map(tuple, D.detect_all(texts, cat, "P", "t", 0.0).collect()))
    small = run()
    monkeypatch.setattr(indexed, "INDEX_BYTES", 2000)
    assert run() == small and len(small) > 100


def test_key_lookup_equals_search(monkeypatch):
    import numpy as np
    import pyarrow as pa
    rng = random.Random(4)
    keys = ["", "abc", "b\tc", "abcab", "cabca", "abcabcab", "zzz"]
    texts = [None, "", "é", "ABCabcabC"] + ["".join(rng.choice("abcB\té") for _ in range(rng.randrange(30))) for _ in range(500)]
    monkeypatch.setattr(indexed, "CHUNK", 64)
    lookup = indexed.Keys(np.array([indexed.code_of(k) for k in keys], np.uint64))
    want = [sorted(indexed.code_of(k) for k in keys if t is not None and k in factors._lower(t)) for t in texts]
    assert lookup.find(pa.array(texts)).to_pylist() == want
    assert lookup.find(pa.array(texts).slice(7, 90)).to_pylist() == want[7:97]
