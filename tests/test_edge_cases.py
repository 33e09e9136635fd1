"""Cases beyond the registered queries' inputs."""

import subprocess
import sys

from pyspark.sql import functions as F

from codesift.functions.regex import check_pattern
from codesift.operators import checks as K
from codesift.operators import clones as CL
from codesift.operators import detect as D
from codesift.operators import symbols as SY


def test_catalogue_size_does_not_change_rows(spark, files_df, monkeypatch):
    pats = [("S%d" % i, "n", "HIGH", "d", [r"os\.system\(" if i % 3 else r"never%d" % i]) for i in range(9)]
    pats += [("BAD", "n", "HIGH", "d", ["("]), ("EMPTY", "n", "HIGH", "d", [r"(?=os\.)"])]
    files = files_df([("a.py", "import os\nos.system('x')\n"), ("b.py", "pass\n")])
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "text"))
    table = spark.createDataFrame([(s, n, sev, i, p) for s, n, sev, _, ps in pats for i, p in enumerate(ps)],
                                  "sig_id string, name string, severity string, pattern_ord int, pattern string")
    sigs = spark.createDataFrame([(s, n, sev, ["python"], ps) for s, n, sev, _, ps in pats],
                                 "sig_id string, name string, severity string, affected_languages array<string>, code_patterns array<string>")
    calls = SY.call_sites(files)

    def run():
        return [sorted(map(tuple, df.collect())) for df in (
            D.detect_all(files, table, min_confidence=0.0), D.detect_lines(lines, table), D.detect_first(files, sigs),
            SY.match_calls(calls, sigs, 0.0), SY.match_similar_calls(calls, sigs))]
    whole = run()
    monkeypatch.setattr(D, "MAX_UNROLLED", 2)
    assert run() == whole
    assert all({r[1] if r[0] in ("signature", "python", "first") else r[2] for r in rows} == {f"S{i}" for i in (1, 2, 4, 5, 7, 8)}
               for rows in whole)


def test_zero_width_patterns_are_rejected(spark):
    assert check_pattern(spark, r"(?=os\.)") and check_pattern(spark, r"(?<!x)a*")
    assert check_pattern(spark, r"(?=os\.)os\.system") is None


def test_first_match_line_after_emoji(spark, files_df):
    sig = [{"sig_id": "S", "name": "n", "severity": "LOW", "affected_languages": ["python"], "code_patterns": [r"eval\("]}]
    r = D.detect_first(files_df([("a.py", "\U0001F600" * 40 + "\neval(x)\n")]), sig).collect()[0]
    assert (r.line_start, r.line_end) == (2, 2)


def test_multi_word_types_are_abstracted(spark):
    df = spark.createDataFrame([("f(unsigned int a) { char * b ; }", ["unsigned int", "char *", "int (*", "**", ""])], "body string, t array<string>")
    got = df.select(CL.abstract_identifiers("body", dtypes="t").alias("x")).first().x
    assert got == "f(DTYPE a) { DTYPE* b ; }" or got.startswith("f(DTYPE a) {DTYPE") or got.startswith("f(DTYPE a) { DTYPE")


def test_calls_on_call_results_and_symbols(spark, files_df):
    files = files_df([("a.py", 'get_shell().run(cmd)\nhandlers[0].call(y)\nclass A(B.C):\n  """doc"""\n  @deco(1)\n  def m(self, x) -> int:\n    pass\nv = [1, q]\n'),
                      ("b.js", "x = 1")])
    assert {r.matched for r in K.sandbox_escape(SY.parse_calls(files)).collect()} == {"get_shell().run(cmd)", "handlers[0].call(y)"}
    rows = {(r.kind, r.name): r for r in SY.symbol_table(files).collect()}
    assert set(rows) == {("class", "A"), ("function", "m"), ("variable", "v")}
    assert rows["class", "A"].docstring == "doc" and rows["class", "A"].methods == ["m"] and rows["class", "A"]["items"] == ["B.C"]
    assert rows["function", "m"].decorators == ["deco"] and rows["function", "m"].value == "int"
    assert rows["variable", "v"].value == "[1, None]"


def test_workers_need_no_copy_of_the_package(tmp_path):
    import codesift
    root = codesift.__file__.rsplit("/codesift/", 1)[0]
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from codesift.session import local_session\nfrom codesift.operators import symbols as SY\n"
            "s = local_session(1)\n"
            "print('ROWS', SY.call_sites(s.createDataFrame([('a.py', 'f(1)')], 'path string, content string')).count())\n")
    import os
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "ROWS 1" in out.stdout, out.stderr[-2000:]
