"""Security checks on the reference snippet, file sources, globs,
incremental scans and the store loader."""

import fnmatch
import json
import os
import tempfile
from pathlib import PurePath

from pyspark.sql import functions as F

from codesift.operators import checks as K
from codesift.operators import symbols as SY
from codesift.sources import files as SF
from codesift.sources import vulnstore as VS
from codesift.streaming import scan as STR

SECURITY_SNIPPET = '''
import os
import sys
import time
import random
import socket
import subprocess

def unsafe_memory():
    # 大量内存分配
    large_list = [i for i in range(10**7)]
    return large_list

def unsafe_execution():
    # 长时间执行
    time.sleep(5)
    return "Done"

def unsafe_file_access():
    # 危险的文件操作
    with open("/etc/passwd", "r") as f:
        data = f.read()
    return data

def unsafe_network():
    # 未经验证的网络连接
    sock = socket.socket()
    sock.connect(("example.com", 80))
    return sock

def unsafe_input():
    # 未验证的输入
    user_input = input("Enter command: ")
    os.system(user_input)

def unsafe_random():
    # 不安全的随机数生成
    return random.randint(1, 100)

def unsafe_sensitive_data():
    # 敏感数据暴露
    password = "super_secret_123"
    print(f"Password is: {password}")

def unsafe_sandbox():
    # 沙箱逃逸尝试
    subprocess.call("rm -rf /", shell=True)
'''


def test_security_checks_snippet(files_df):
    files = files_df([("t.py", SECURITY_SNIPPET)])
    got = {(r.check, r.matched, r.line_no) for r in K.security_check(files).collect()}
    assert not any(c == "file_access" for c, _, _ in got)
    assert ("network_access", "socket.socket", 27) in got
    assert ("random_generation", "random.randint", 38) in got
    assert {("sensitive_data", "password", 42), ("sensitive_data", "secret", 42),
            ("sensitive_data", "password", 43)} <= got
    assert ("sensitive_data", 'print(f"Password is: {password}")', 43) in got
    assert ("memory_usage", "[i for i in range(10**7)]", 11) in got
    assert ("execution_time", "time.sleep(", 16) in got
    calls = SY.call_sites(files)
    inp = {(r.matched, r.line_no) for r in K.input_validation(calls).collect()}
    assert inp == {("input", 33)}
    sand = {r.matched for r in K.sandbox_escape(calls).collect()}
    assert sand == {"os.system(user_input)", "subprocess.call('rm -rf /', shell=True)"}


def test_full_check_clean_and_empty_files(files_df):
    files = files_df([("t.py", SECURITY_SNIPPET), ("empty.py", "")])
    findings = K.security_check(files)
    full = {(r.path, r.check): r for r in K.full_check(files, findings, K.ALL_CHECKS).collect()}
    assert len(full) == 2 * len(K.ALL_CHECKS)
    assert not any(r.has_issues for (p, _c), r in full.items() if p == "empty.py")
    assert full[("t.py", "sensitive_data")].details["password"] is not None


def test_scan_corpus_encodings_and_filters(spark):
    root = tempfile.mkdtemp(prefix="corpus-")
    os.makedirs(f"{root}/pkg/test")
    with open(f"{root}/pkg/a.py", "wb") as fh:
        fh.write("x = '한'\r\nprint(x)\r\n".encode("utf-8"))
    with open(f"{root}/pkg/b.py", "wb") as fh:
        fh.write("y = '한국'\n".encode("cp949"))
    with open(f"{root}/pkg/test/c.py", "wb") as fh:
        fh.write(b"z = 1\n")
    with open(f"{root}/big.js", "wb") as fh:
        fh.write(b"a" * 5000)
    files = SF.scan_corpus(spark, root, max_bytes=1000, exclude=["test"], exclude_mode="basename")
    got = {r.path: r.content for r in files.collect()}
    assert got == {"pkg/a.py": "x = '한'\nprint(x)\n", "pkg/b.py": "y = '한국'\n"}


def test_glob_translation_matches_python():
    paths = ["src/m2/f1.py", "src/m2/sub/f.py", "a/src/m31/x.py", "src/m31/x.js", "f4a.js", "d/f4.js", "test/x"]
    for g in ["**/m2/*", "src/m3?/*.py", "f4*.js", "test/*", "[!s]*/x.py"]:
        import re
        rx = re.compile(SF.glob_regex(g, "path"))
        for p in paths:
            assert bool(rx.search(p)) == PurePath(p).match(g), (g, p)
    for g in ["m1*", "*.js", "f?.py", "[a-c]*"]:
        rx = re.compile(SF.glob_regex(g, "basename"))
        for name in ["m12", "x.js", "f1.py", "b.txt", "zz"]:
            assert bool(rx.search(name)) == fnmatch.fnmatchcase(name, g), (g, name)


def test_incremental_rescans_edited_files(spark, files_df):
    def detect(files):
        return files.select("path", F.lit("X").alias("sig_id"), F.length("content").alias("n"))

    v1 = files_df([("a.py", "one"), ("b.py", "two")]).withColumn("sha256", F.sha2("content", 256))
    empty = spark.createDataFrame([], "path string, sha256 string")
    res0 = spark.createDataFrame([], "path string, sig_id string, n int, sha256 string")
    res1, state1, fresh1 = STR.scan_incremental(v1, empty, res0, detect)
    assert fresh1.count() == 2
    v2 = files_df([("a.py", "one"), ("b.py", "two, edited"), ("c.py", "new")]).withColumn(
        "sha256", F.sha2("content", 256))
    res2, _s, fresh2 = STR.scan_incremental(v2, state1, res1, detect)
    assert sorted(r.path for r in fresh2.collect()) == ["b.py", "c.py"]
    assert sorted((r.path, r.n) for r in res2.collect()) == [("a.py", 3), ("b.py", 11), ("c.py", 3)]


def test_vuln_store_loader_priority_and_bare_deps(spark):
    from codesift.operators import clones as CL

    root = tempfile.mkdtemp(prefix="store-")
    for sub in ("vulHashes", "vulBodySet", "vulESSLines", "noOldESSLines", "patESSLines", "vulDEPLines"):
        os.makedirs(f"{root}/{sub}")
    open(f"{root}/oss_idx.txt", "w").write("libx@@CVE1\nlibx@@CVE2\nliby@@CVE3")
    open(f"{root}/idx2cve.txt", "w").write("CVE1##CVE-2020-1\nCVE1##CVE-2020-9\nCVE2##CVE-2021-2")
    open(f"{root}/vulHashes/libx_hash.txt", "w").write("h1\tf##a@@b.c\nh2\tg")
    json.dump({"vul_body": ["a", "b", "c", "d"], "old_body": ["a", "b"]}, open(f"{root}/vulBodySet/CVE1_x.json", "w"))
    json.dump([{"vul_body": "a", "abs_body": "A"}], open(f"{root}/vulESSLines/CVE1_common.txt", "w"))
    json.dump([{"vul_body": "z", "abs_body": "Z"}], open(f"{root}/noOldESSLines/CVE1_minus.txt", "w"))
    json.dump([{"pat_body": "p", "abs_body": "P"}], open(f"{root}/patESSLines/CVE1_plus.txt", "w"))
    json.dump({"k": [{"abs_norm_vul": "d1", "orig_norm_vul": "d1"}]}, open(f"{root}/vulDEPLines/CVE1_depen.txt", "w"))
    st = VS.load_vuln_store(spark, root)
    assert {r.cve for r in st["vuln_cve"].where("vuln_idx = 'CVE1'").collect()} == {"CVE-2020-9"}
    assert {(r.origin, r.dep_key, r.orig_norm_vul) for r in st["dep_lines"].collect()} == {("vul", "k", "d1")}
    rules = CL.vuln_rules(st).first()
    assert rules.flag == 2 and rules.core_norm == ["a"] and rules.new_pat == ["p"]


def test_recursive_double_star_option():
    import re
    rx = re.compile(SF.glob_regex("**/test/*.py", "path", recursive=True))
    assert rx.search("test/a.py") and rx.search("x/y/test/a.py")
    assert not rx.search("x/test/sub/a.py")
    strict = re.compile(SF.glob_regex("**/test/*.py", "path"))
    assert not strict.search("test/a.py") and strict.search("x/test/a.py")


def test_extract_functions_last_wins_and_overloads(spark):
    from codesift.operators import clones as CL
    lines = spark.createDataFrame([("a.c", i, t) for i, t in enumerate(
        ["int f(int a) {", "  return a;", "}", "int f(char b) {", "  return b;", "}"], 1)],
        "path string, line_no int, text string")
    tags = spark.createDataFrame([("a.c", "f", "function", 1, 3, None), ("a.c", "f", "function", 4, 6, None)],
                                 "path string, name string, kind string, line int, end_line int, typeref string")
    one = CL.extract_functions(lines, tags).collect()
    assert len(one) == 1 and one[0].start_line == 4
    both = CL.extract_functions(lines, tags, keep_overloads=True).collect()
    assert sorted(r.name for r in both) == ["f@1", "f@4"]


def test_go_form_call_checks(files_df):
    go = 'package m\nfunc main() {\n  fmt.Scanln(&x)\n  s := bufio.NewScanner(r)\n  exec.Command("ls").Run()\n  os.Remove(p)\n}\n'
    calls = SY.call_sites_regex(files_df([("m.go", go)]))
    inp = sorted((r.matched, r.line_no) for r in K.input_validation_go(calls).collect())
    assert inp == [("bufio.NewScanner", 4), ("fmt.Scanln", 3)]
    sand = sorted((r.matched, r.line_no) for r in K.sandbox_escape_go(calls).collect())
    assert sand == [("exec.Command", 5), ("os.Remove", 6)]


def test_scan_directory_end_to_end(spark, tmp_path):
    from codesift.plans.directory import scan_directory
    src = tmp_path / "proj"
    (src / "pkg").mkdir(parents=True)
    (src / "vendor").mkdir()
    (src / "pkg" / "a.py").write_text("import pickle\nobj = pickle.loads(blob)\ntry:\n    f()\nexcept:\n    pass\n")
    (src / "pkg" / "b.js").write_text("el.innerHTML = html;\nconsole.log(x);\n")
    (src / "vendor" / "c.py").write_text("eval(x)\n")
    out = tmp_path / "report"
    findings = scan_directory(spark, str(src), str(out), formats=("json", "xml"), exclude=["vendor"])
    got = sorted((r.path, r.sig_id, r.line_start) for r in findings.collect())
    assert got == [("pkg/a.py", "PY003", 2), ("pkg/a.py", "PY011", 5), ("pkg/a.py", "PY012", 5),
                   ("pkg/b.js", "JS003", 1), ("pkg/b.js", "JS011", 2)]
    summary = spark.read.json(str(out / "json" / "summary")).first()
    assert (summary.total_files, summary.high, summary.medium, summary.low) == (2, 2, 2, 1)
    xml = spark.read.format("xml").option("rowTag", "file").load(str(out / "xml" / "results"))
    assert sorted(r._path for r in xml.collect()) == ["pkg/a.py", "pkg/b.js"]


def test_lineage_helpers_and_jaccard_column(spark):
    from codesift.functions import text as TX
    from codesift.session import cut_lineage, materialize
    df = spark.range(10).withColumn("sq", F.col("id") * F.col("id"))
    m = materialize(df, "squares")
    assert sorted(r.sq for r in m.collect()) == [i * i for i in range(10)]
    c = cut_lineage(df.where(F.col("id") > 4))
    assert c.count() == 5
    j = spark.createDataFrame([(["a", "b", "c"], ["a", "a", "b"])], "x array<string>, y array<string>")
    quirk, strict = j.select(TX.jaccard("x", "y"), TX.jaccard("x", "y", strict=True)).first()
    assert abs(quirk - 2 / (3 + 3 - 2)) < 1e-12 and abs(strict - 2 / 3) < 1e-12


def test_first_match_strict_extension_parity(spark, files_df):
    from codesift.operators import detect as D
    from codesift.sources import catalog as CAT
    files = files_df([("a.py", "os.system(cmd)\n")])
    sigs = CAT.cwe_signatures(spark)
    assert D.detect_first(files, sigs, strict_ext=True).count() == 0  # raw 'py' never equals 'python'
    assert D.detect_first(files, sigs, strict_ext=False).count() > 0


def test_large_file_and_many_files_bounds(spark, files_df):
    import time
    stmts = "\n".join(f"x{i} = random.randint(1, {i})" if i % 100 == 0 else f"y{i} = {i}" for i in range(10_000))
    files = files_df([("big.py", stmts)])
    t0 = time.time()
    full = K.full_check(files, K.security_check(files), K.ALL_CHECKS).collect()
    assert time.time() - t0 < 30
    rnd = [r for r in full if r.check == "random_generation"][0]
    assert rnd.n_issues == 100
    same = files_df([(f"f{i}.py", "import random\nv = random.random()\n") for i in range(100)])
    t0 = time.time()
    rows = K.full_check(same, K.security_check(same), K.ALL_CHECKS).where("has_issues").collect()
    assert time.time() - t0 < 60
    assert len({r.path for r in rows}) == 100


def test_corpus_files_against_hashlib(spark):
    import hashlib
    import os
    from codesift.plans.registry import QUERIES
    sf = "/root/testdata/sf0.001"
    got = {r.path: (r.size, r.sha256) for r in QUERIES["corpus_files"](spark, sf).collect()}
    exp = {}
    for name in sorted(os.listdir(sf)):
        p = os.path.join(sf, name)
        if os.path.isfile(p):
            data = open(p, "rb").read()
            exp[name] = (len(data), hashlib.sha256(data).hexdigest())
    assert got == exp


def test_full_check_one_shuffle_without_the_grid(spark, files_df):
    files = files_df([("a.py", "x"), ("a.py", "x"), (None, "y"), ("clean.py", "z")])
    cols = "path string, check string, pattern_ord int, matched string, offset int, line_no int"
    findings = spark.createDataFrame([
        ("a.py", "file_access", 0, "open", 9, 2), ("a.py", "file_access", 1, "open", 3, 1), ("a.py", "file_access", 1, "rm", 0, 1),
        ("a.py", "sandbox_escape", -1, None, None, None), (None, "file_access", 0, "open", None, 4), (None, "file_access", 0, "open", None, 6),
        ("other.py", "sandbox_escape", 0, "eval(x)", None, 7), ("a.py", "unknown", 0, "open", 1, 1)], cols)
    out = K.full_check(files, findings, ["file_access", "sandbox_escape"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "explode(array(file_access" not in plan  # the grid is made behind the shuffle
    got = {(r.path, r.check): (r.has_issues, r.n_issues, r.details) for r in out.collect()}
    assert got == {
        ("a.py", "file_access"): (True, 3, {"open": 3, "rm": 0}), ("a.py", "sandbox_escape"): (True, 1, {}),
        (None, "file_access"): (True, 2, {"open": 6}), (None, "sandbox_escape"): (False, 0, None),
        ("clean.py", "file_access"): (False, 0, None), ("clean.py", "sandbox_escape"): (False, 0, None),
        ("other.py", "sandbox_escape"): (True, 1, {"eval(x)": 7})}


def test_security_check_finds_matches_once(files_df):
    out = K.security_check(files_df([("a.py", "requests.get(u)\nrequests.get(v)")]), ["network_access"])
    assert [(r.matched, r.offset, r.line_no) for r in out.collect()] == [("requests.get", 0, 1), ("requests.get", 16, 2)]
    # as the optimizer leaves it: no filter that repeats the search
    assert "Filter (size(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_call_checks_emit_only_the_calls_they_report(files_df):
    from codesift.operators import symbols as SY
    files = files_df([("a.py", "x = input('q')\nprint(len(x))\ns.get(k)\na.b.get(k)\nos.system(c)\neval(x)\nrun(x)"), ("bad.py", "except:"),
                      ("long.py", "print(-0x" + "f" * 5000 + ")")])
    named = SY.calls_named(files, ["input", "eval"], ["get", "system"]).collect()
    assert sorted((r.path, r.func_name) for r in named if r.error is None) == [
        ("a.py", "a.b.get"), ("a.py", "eval"), ("a.py", "input"), ("a.py", "os.system"), ("a.py", "s.get")]
    assert sorted(r.path for r in named if r.error is not None) == sorted(
        r.path for r in SY.parse_calls(files).where("error is not null").collect()) == ["bad.py", "long.py"]
    assert sorted((r.path, r.check, r.matched, r.line_no) for r in K.call_checks(files).where("matched is not null").collect()) == [
        ("a.py", "input_validation", "input", 1), ("a.py", "input_validation", "s.get", 3),
        ("a.py", "sandbox_escape", "eval(x)", 6), ("a.py", "sandbox_escape", "os.system(c)", 5)]
