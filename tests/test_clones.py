"""Clone detection: brute-force set semantics vs the Spark plan."""

import pytest
from pyspark.sql import functions as F

from codesift.functions import text as TX
from codesift.operators import clones as CL
from codesift.plans import corpus as C
from codesift.plans import store as ST

SF0001 = "/root/testdata/sf0.001"


def _norm(s):
    return s.replace("\r", "").replace("\t", "").replace(" ", "").lower()


def brute_force_d1(functions, store, theta=0.5):
    """The per-pair rules written directly over Python sets."""
    coll = lambda k: [r.asDict(recursive=True) for r in store[k].collect()]
    oss_idx, hashes = coll("oss_idx"), coll("vuln_hash")
    osses = {r["oss"] for r in oss_idx}
    known = {(r["oss"], r["hash"]) for r in hashes if r["oss"] in osses}
    hit_oss, hit_dirs = set(), set()
    for f in functions:
        for oss, h in known:
            if f["norm_hash"] == h:
                hit_oss.add(oss)
                hit_dirs.add(f["dir"])
    reused = {r["vuln_idx"] for r in oss_idx if r["oss"] in hit_oss}
    targets = [f for f in functions if f["dir"] in hit_dirs]
    bodies = {r["vuln_idx"]: r for r in coll("vuln_body")}
    ess, pats, deps = {}, {}, {}
    for r in coll("ess_lines"):
        ess.setdefault(r["vuln_idx"], {}).setdefault(r["kind"], []).append(r)
    for r in coll("pat_lines"):
        pats.setdefault(r["vuln_idx"], []).append(r)
    for r in coll("dep_lines"):
        deps.setdefault(r["vuln_idx"], []).append(r)
    cves = {r["vuln_idx"]: r["cve"] for r in coll("vuln_cve")}
    out = set()
    import re
    t3 = re.compile(r'(?P<c>//.*?$|[{}]+)|(?P<m>/\*.*?\*/)|(?P<n>\'(\\.|[^\\\'])*\'|"(\\.|[^\\"])*"|.[^/\'"]*)',
                    re.DOTALL | re.MULTILINE)
    rc = lambda s: "".join(m.group("n") for m in t3.finditer(s) if m.group("n"))
    for idx in reused:
        body = bodies[idx]
        e = ess.get(idx, {})
        e = e.get("common") or e.get("minus") or []
        p = pats.get(idx, [])
        if not e and not p:
            continue
        flag = 3 if (p and not e) else 2 if p else 1
        vul_list = body["vul_body"] or []
        new_pat = {_norm(x["pat_body"]) for x in p if _norm(x["pat_body"]) not in vul_list} - {"", "{", "}"}
        new_abs = {_norm(x["abs_body"]) for x in p if _norm(x["pat_body"]) not in vul_list} - {"", "{", "}"}
        is_abs = (set(_norm(x["abs_body"]) for x in p) != set(_norm(x["abs_body"]) for x in e)) if (p and e) else True
        core_abs = {_norm(x["abs_body"]) for x in e}
        core_nor = {_norm(x["vul_body"]) for x in e}
        d = deps.get(idx, [])
        dva = {rc(x["abs_norm_vul"]) for x in d if x["origin"] == "vul"}
        dvn = {rc(x["orig_norm_vul"]) for x in d if x["origin"] == "vul"}
        doa = {rc(x["abs_norm_vul"]) for x in d if x["origin"] == "old"}
        don = {rc(x["orig_norm_vul"]) for x in d if x["origin"] == "old"}
        vset, oset = set(vul_list), set(body["old_body"] or [])
        if len(vset) <= 3:
            continue
        for f in targets:
            x, y = set(f["norm"]), set(f["abst"])
            if flag == 3:
                ok = bool(new_abs) and new_abs.isdisjoint(y)
            elif is_abs:
                ok = core_abs <= y and (dva <= y or (bool(doa) and doa <= y)) and (flag != 2 or new_abs.isdisjoint(y))
            else:
                ok = core_nor <= x and (dvn <= x or (bool(don) and don <= x)) and (flag != 2 or new_pat.isdisjoint(x))
            if not ok:
                continue
            if len(vset & x) / len(vset) >= theta:
                out.add((idx, cves.get(idx), f["func_id"], "vul"))
            elif oset and len(oset & x) / len(oset) >= theta:
                out.add((idx, cves.get(idx), f["func_id"], "old"))
    return out


def test_detect_clones_matches_brute_force(spark):
    functions = C.syn_functions(spark, SF0001).cache()
    store = ST.build_store(spark, SF0001)
    got = {(r.vuln_idx, r.cve, r.func_id, r.matched_on)
           for r in CL.detect_clones(functions, store).collect()}
    fl = [r.asDict(recursive=True) for r in functions.select("func_id", "dir", "norm", "abst", "norm_hash").collect()]
    exp = brute_force_d1(fl, store)
    assert got == exp
    assert len(got) > 0


def test_containment_salted_equals_broadcast(spark, monkeypatch):
    functions = C.syn_functions(spark, SF0001).select("func_id", "norm")
    b = ST.build_store(spark, SF0001)["vuln_body"]
    bodies = b.select("vuln_idx", F.lit("vul").alias("which"), F.col("vul_body").alias("body"))
    cols = ["func_id", "vuln_idx", "which", "shared", "size_v"]
    a = {tuple(r) for r in CL.containment_pairs(functions, bodies).select(*cols).collect()}
    monkeypatch.setattr(CL, "BROADCAST_BYTES", 1)
    s = {tuple(r) for r in CL.containment_pairs(functions, bodies, salt_buckets=4).select(*cols).collect()}
    assert a == s and len(a) > 0
    for r in CL.containment_pairs(functions, bodies).collect():
        assert 0.5 <= r.containment <= 1.0


def test_jaccard_quirk_and_strict(spark):
    a = spark.createDataFrame([("a", ["x", "y", "z"])], "a_id string, lines array<string>")
    b = spark.createDataFrame([("b", ["x", "x", "y"])], "b_id string, lines array<string>")
    q = CL.jaccard_pairs(a, b, 0.0).first()
    assert q.jaccard == pytest.approx(2 / (3 + 3 - 2))  # b keeps its duplicate
    s = CL.jaccard_pairs(a, b, 0.0, strict=True).first()
    assert s.jaccard == pytest.approx(2 / 3)


def test_abstraction_quirk(spark):
    df = spark.createDataFrame([("x = x + 1\nx = 2",)], "body string")
    got = df.select(CL.abstract_identifiers(F.col("body"), locals_=F.array(F.lit("x")))).first()[0]
    import re
    exp = re.sub(r"(^|\W)x(\W)", r"\g<1>LVAR\g<2>", "x = x + 1\nx = 2")
    assert got == exp


def test_strip_comments_and_long_literal(spark):
    import re
    t3 = re.compile(r'(?P<c>//.*?$|[{}]+)|(?P<m>/\*.*?\*/)|(?P<n>\'(\\.|[^\\\'])*\'|"(\\.|[^\\"])*"|.[^/\'"]*)',
                    re.DOTALL | re.MULTILINE)
    cases = ['int a = 1; // c\n{ b = "x // y"; /* z\n w */ }', "char c = '\\''; s = \"unterminated", "{}}{a}",
             'x = "' + "a" * 200_000 + '"; // tail']
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = [r[0] for r in df.select(TX.strip_comments(F.col("s"))).collect()]
    exp = ["".join(m.group("n") for m in t3.finditer(c) if m.group("n")) for c in cases]
    assert got == exp


def test_prefix_strategy_equals_counts_and_brute_force(spark):
    functions = C.syn_functions(spark, SF0001).cache()
    store = ST.build_store(spark, SF0001)
    cols = ["vuln_idx", "func_id", "vul_ok", "old_ok", "ess_ok", "dep_ok", "patch_ok", "ok"]
    a = {tuple(r) for r in CL.rule_checks(functions, store, strategy="counts").select(*cols).collect()}
    b = {tuple(r) for r in CL.rule_checks(functions, store, strategy="prefix").select(*cols).collect()}
    assert a == b and len(a) > 0
    got = {(r.vuln_idx, r.cve, r.func_id, r.matched_on)
           for r in CL.detect_clones(functions, store, strategy="prefix").collect()}
    fl = [r.asDict(recursive=True) for r in functions.select("func_id", "dir", "norm", "abst", "norm_hash").collect()]
    assert got == brute_force_d1(fl, store)


C_TARGET = """#include <stdio.h>
int helper(int a) { return a + 1; }

int copy_buf(char *dst, char *src, int n)
{
    int i;
    for (i = 0; i <= n; i++) {
        dst[i] = src[i];
    }
    log_copy(dst);
    return n;
}
"""


def test_extract_functions_braces(spark):
    from codesift.sources.files import to_lines
    files = spark.createDataFrame([("src/a.c", C_TARGET)], "path string, content string")
    fns = {r.name: (r.start_line, r.end_line) for r in CL.extract_functions_braces(to_lines(files)).collect()}
    assert fns == {"helper": (2, 2), "copy_buf": (4, 12)}


def test_clone_scan_directory_end_to_end(spark, tmp_path):
    import json
    from codesift.functions import text as TX
    from codesift.plans.directory import clone_scan_directory
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.c").write_text(C_TARGET)
    # a patched copy in the same directory: essential line gone, patch line present -> not reported
    (root / "src" / "b.c").write_text(C_TARGET.replace("copy_buf", "copy_fixed").replace("i <= n", "i < n"))
    # the vulnerable body is the target function's own normalised lines
    body_df = spark.createDataFrame([(C_TARGET.split("\n\n", 1)[1].strip("\n"),)], "b string")
    norm = body_df.select(TX.norm_lines(F.col("b")).alias("n")).first().n
    h = body_df.select(TX.function_hash(TX.norm_lines(F.col("b")))).first()[0]
    store = tmp_path / "store"
    for sub in ("vulHashes", "vulBodySet", "noOldESSLines", "patESSLines"):
        (store / sub).mkdir(parents=True)
    (store / "oss_idx.txt").write_text("libcopy@@V1")
    (store / "idx2cve.txt").write_text("V1##CVE-2024-0001")
    (store / "vulHashes" / "libcopy_hash.txt").write_text(f"{h}\tcopy_buf")
    (store / "vulBodySet" / "V1_body.json").write_text(json.dumps({"vul_body": norm}))
    ess = [{"vul_body": "for(i=0;i<=n;i++){", "abs_body": "for(i=0;i<=n;i++){"}]
    (store / "noOldESSLines" / "V1_minus.txt").write_text(json.dumps(ess))
    pat = [{"pat_body": "for(i=0;i<n;i++){", "abs_body": "for(i=0;i<n;i++){"}]
    (store / "patESSLines" / "V1_plus.txt").write_text(json.dumps(pat))
    got = [(r.vuln_idx, r.cve, r.name, r.path) for r in clone_scan_directory(spark, str(root), str(store)).collect()]
    assert got == [("V1", "CVE-2024-0001", "copy_buf", "src/a.c")]


def test_strategies_agree_on_c_view(spark):
    functions = C.syn_c_functions(spark, SF0001).cache()
    store = ST.build_store(spark, SF0001, c_view=True)
    a = {tuple(r) for r in CL.detect_clones(functions, store, strategy="counts").collect()}
    b = {tuple(r) for r in CL.detect_clones(functions, store, strategy="prefix").collect()}
    assert a == b and len(a) > 0
    fl = [r.asDict(recursive=True) for r in functions.select("func_id", "dir", "norm", "abst", "norm_hash").collect()]
    assert {(r[0], r[1], r[2], r[5]) for r in a} == brute_force_d1(fl, store)


def test_tags_in_functions_orders_types_params_first(spark):
    tags = spark.createDataFrame([
        ("a.c", "f", "function", 1, 9, None),
        ("a.c", "n", "local", 2, None, "size_t"),
        ("a.c", "p", "parameter", 1, None, "buf_t"),
        ("a.c", "q", "parameter", 1, None, "len_t")],
        "path string, name string, kind string, line int, end_line int, typeref string")
    r = CL.tags_in_functions(tags).first()
    assert r.params == ["p", "q"] and r.locals == ["n"] and r.dtypes == ["buf_t", "len_t", "size_t"]


TRICKY_C = '''#if 0
#define BEGIN { do \\
   { foo(
#endif
namespace a {
extern "C" {
static const char *t[] = { "{", "}" };
struct p { int q; };
int one(int a) { char c = '{'; return a; } /* } */
// int not(int a) {
__attribute__((noinline)) int
two(int a,
    char *s)  // (
{
    if (a) { s = "\\"}"; }
    /* {
       { */
}
}
int three(void);
Foo::Foo(int a) : x(a), y{1} { z(); }
#define M(x) }
int one(int again)
{ }
}
int open_end(void) {
    x();
'''


def test_brace_fold_skips_strings_comments_and_macros(spark):
    files = spark.createDataFrame([("t.cpp", TRICKY_C), ("n.c", None), ("e.c", ""), ("r.c", "int a()\r\n{\r\n}\r\n")], "path string, content string")
    got = {(r.path, r.name): (r.start_line, r.end_line, r.body) for r in CL.extract_functions_braces(files).collect()}
    lines = TRICKY_C.split("\n")
    spans = {"one": (23, 24), "two": (12, 18), "open_end": (26, len(lines)), "Foo": (21, 21)}
    assert {k[1]: v[:2] for k, v in got.items() if k[0] == "t.cpp"} == spans
    assert got["t.cpp", "two"][2] == "\n".join(lines[11:18]) and got["r.c", "a"] == (1, 3, "int a()\n{\n}")
    plan = CL.extract_functions_braces(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_interval_joins_with_2000_functions_in_one_file(spark):
    rows, text = [], []
    for i in range(2000):
        start = len(text) + 1
        body = [f"int f{i}(int p{i})", "{", *[f"  int v{i} = {k};" for k in range(i % 90)], "}"]
        text += [*body, ""]
        rows.append(("a.c", f"f{i}", "function", start, start + len(body) - 1, None))
        rows.append(("a.c", f"p{i}", "parameter", start, None, "int"))
        rows += [("a.c", f"v{i}", "local", start + 2, None, "int")] if i % 90 else []
    rows.append(("a.c", "whole", "function", 1, len(text), None))
    tags = spark.createDataFrame(rows, "path string, name string, kind string, line int, end_line int, typeref string").repartition(4)
    lines = spark.createDataFrame([("a.c", k + 1, t) for k, t in enumerate(text)], "path string, line_no int, text string").repartition(4)
    fns = CL.extract_functions(lines, tags)
    got = {r.name: r.body for r in fns.collect()}
    assert got == {n: "\n".join(text[a - 1:b]) for _, n, k, a, b, _ in rows if k == "function"}
    ids = CL.tags_in_functions(tags)
    own = {r.name: (r.params, r.locals) for r in ids.collect()}
    assert own["f7"] == (["p7"], ["v7"]) and own["f90"] == (["p90"], []) and len(own["whole"][0]) == 2000
    for df in (fns, ids):                       # every join has the bin of lines in its key
        joins = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x and "path" in x]
        assert joins and all("bin" in x for x in joins)


def test_words_in_one_pass_equal_patterns(spark):
    import random
    import re
    rng = random.Random(8)
    words = ["a", "b", "int", "unsigned", "x1", "é", "FPARAM", "ab"]
    body = lambda: "".join(rng.choice(words) + rng.choice([" ", ",", "; ", "(", "\n", "  ", "", "+"]) for _ in range(rng.randint(0, 12)))
    ids = lambda: [rng.choice(["a", "b", "int", "x1", "é", "unsigned int", "zz", "ab"]) for _ in range(rng.randint(0, 3))]
    rows = [(i, body(), ids(), ids(), ids() or None) for i in range(600)] + [(900, "", ["a"], ["b"], ["c"]), (901, None, ["a"], None, None)]
    df = spark.createDataFrame(rows, "i int, body string, p array<string>, d array<string>, l array<string>")
    got = {r.i: r.x for r in df.select("i", CL.abstract_identifiers("body", "p", "d", "l").alias("x")).collect()}
    for i, t, p, d, l in rows:
        for names, token in ((p, "FPARAM"), (d, "DTYPE"), (l, "LVAR")):
            for n in names or []:
                t = t and re.sub(rf"(^|\W){n}(\W)", rf"\1{token}\2", t)
        assert got[i] == t, rows[i] if i < 600 else i
