"""What is computed once: columns used in lambdas, texts of lines, contents of an incremental scan."""

import re

from pyspark.sql import functions as F

from codesift.functions import text as TX
from codesift.operators import clones as CL
from codesift.operators import detect as D
from codesift.plans import corpus as C
from codesift.sources import sinks as SK
from codesift.streaming import scan as STR


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bind_computes_its_value_once_and_passes_null(spark):
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    out = df.select(TX.bind(F.upper("t"), lambda x: F.concat(x, x)).alias("x"))
    assert [r.x for r in out.collect()] == ["A BA B", None]
    assert _plan(out).count("upper(") == 1


def test_semantic_form_finds_identifiers_once(spark):
    df = spark.createDataFrame([("a = b + a  # c\nf('x', \"y\")",), ("",), (None,), ("1 + 2",)], "t string")
    out = df.select(TX.semantic_form("t").alias("x"))
    assert [r.x for r in out.collect()] == ["var0 = var1 + var0 var2('', \"\")", "", None, "1 + 2"]
    plan = _plan(out)
    assert plan.count("regexp_extract_all(") == 1
    assert len(re.findall(r"regexp_replace\(", plan)) == 6


def test_abstraction_computes_each_body_once(spark):
    df = spark.createDataFrame([("int f(a, n) { x = a; return x+n; }", ["a", "n"], ["int"], ["x"]), ("y", ["y"], None, []), (None, ["a"], [], [])],
                               "body string, p array<string>, d array<string>, l array<string>")
    out = df.select(CL.abstract_identifiers("body", F.col("p"), F.col("d"), F.col("l")).alias("x"))
    assert [r.x for r in out.collect()] == ["DTYPE f(FPARAM, FPARAM) { LVAR = FPARAM; return LVAR+FPARAM; }", "y", None]
    assert _plan(out).count("regexp_extract_all(") == 3


def test_fused_scan_strips_a_line_once(spark):
    files = spark.createDataFrame([("a.py", "x = eval(src)\r\ny = 1\n"), ("b.py", None)], "path string, content string")
    out = D.scan_files_fused(files, D.GO_LINE_GROUPS, ())
    assert {(r.path, r.line_start, r.matched_code) for r in out.collect()} == {("a.py", 1, "x = eval(src)")}
    assert _plan(out).count("regexp_replace(") == 1


def test_files_are_put_together_behind_the_shuffle(spark):
    cols = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, " \
           "l_discount double, l_tax double, l_shipdate timestamp"
    rows = [(k, p, 7, n, 1.0, 2.0, 0.0, 0.0, None) for k, p, n in ((5, 4, 1), (6, 1, 2), (5, 3, 2), (5, 3, 2), (None, 0, 1))]
    li = spark.createDataFrame(rows, cols)
    files = C.syn_files(spark, "", source=li)
    got = {(r.file_id, r.path, tuple(r.lines), r.content, r.n_lines) for r in files.collect()}
    five = ("import os", "import os", "import os")
    assert got == {(5, "src/m5/f5.js", five, "\n".join(five), 3), (6, "src/m6/f6.py", ('password = "pw7"',), 'password = "pw7"', 1),
                   (None, None, ("subprocess.call(args, shell=True)",), "subprocess.call(args, shell=True)", 1)}
    plan = files._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange"):]
    assert "collect_list" not in below and "CASE" not in below


def test_xml_files_hold_a_bounded_number_of_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SK, "XML_DOCUMENTS", 3)
    row = ("d", "S1", "n", "high", "", 1, 1, "code", 0.9)
    matches = spark.createDataFrame([row[:4] + (f"f{i}.py",) + row[5:] for i in range(10)], D.match_schema()).coalesce(1)
    SK.write_xml(matches, f"{tmp_path}/r")
    back = SK.read_xml_report(spark, f"{tmp_path}/r")
    per_file = back.groupBy(F.input_file_name().alias("f")).count().collect()
    assert sum(r["count"] for r in per_file) == 10 and max(r["count"] for r in per_file) <= 3


def test_incremental_scan_selects_what_is_new_once(spark):
    files = spark.createDataFrame([("a.py", "1", "x"), ("b.py", "2", "y")], "path string, sha256 string, content string")
    state = spark.createDataFrame([("a.py", "1")], "path string, sha256 string")
    results = spark.createDataFrame([("a.py", "1", 0)], "path string, sha256 string, n int")

    def detect(todo):  # two detectors
        return todo.select("path", F.lit(1).alias("n")).unionByName(todo.select("path", F.lit(2).alias("n")))

    got, _now, fresh = STR.scan_incremental(files, state, results, detect)
    assert sorted((r.path, r.n) for r in got.collect()) == [("a.py", 0), ("b.py", 1), ("b.py", 2)]
    assert "LeftAnti" not in _plan(fresh)
    first, _now, _ = STR.scan_incremental(files, STR.empty(spark, "path string, sha256 string"),
                                          STR.empty(spark, "path string, sha256 string, n int"), detect)
    assert first.count() == 4 and "LeftSemi" not in _plan(first)
