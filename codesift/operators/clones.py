"""Vulnerable-clone detection.

Plan at scale
-------------
``functions`` (the target corpus) is the big side; the vulnerability store is
bounded by the number of known vulnerabilities, not by the corpus.

1. J1  hash hits: ``functions.norm_hash`` = known vulnerable hash — an
   equi-join against the store's hash table (broadcast after a check of its
   bytes, shuffled join above the bound).
2. J2  reused vulnerabilities and J3 directory reduction: semi-joins (the
   directory list is broadcast after a check).
3. Pairs, never a cross join.  Strategy ``counts``: each function's distinct
   normalised / abstract lines are joined on the line to every store line
   set (vulnerable body, oldest body, essential, dependency, patch lines)
   and counted per (function, vulnerability) in one partial-aggregated
   shuffle; containment (J8) and the rules J5/J6/J7 are comparisons of
   those counts with the set sizes.  Strategy ``prefix`` (chosen when one
   line belongs to many store sets): candidates come only from each body's
   rarest lines (prefix filtering), exact counts from the arrays.
4. Store-side tables have a long lineage, so each is written once from the
   tasks to the shared checkpoint folder and read back; nothing passes
   through the driver.  The written bytes decide between a broadcast and a
   shuffled join, in which the line join is salted so a line shared by a
   third of all functions (``''``, ``}``, ``return0;``) spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..session import materialize

THETA = 0.5
BROADCAST_BYTES = 16 * 1024 * 1024  # written (compressed) bytes of a store table; above this joins shuffle
SALT_BUCKETS = 32
BIN_LINES = 64  # lines of one bin of an interval join
# Largest number of store line sets one line may belong to for the single
# inverted count join; above it candidates come from prefix filtering.
MAX_FANOUT = 64


# --- T4 / T5 / T6 / T7 --------------------------------------------------------------

# Names and type spellings that are valid regexes in every dialect: plain
# characters, simple bracket groups, and single quantifiers after something.
_USABLE_ID = (r"(?U)^(?:[\w \t:.,<>&=/@#%!'\";~-]|\[\w+\])"
              r"(?:[\w \t:.,<>&=/@#%!'\";~-]|\[\w+\]|[*?](?![*?+{]))*$")


def _replace_ids(body: Column, ids: Column, token: str) -> Column:
    """Replace each id with ``token`` where it stands between non-word chars
    (``(^|\\W)id(\\W)``, neighbours consumed, so adjacent hits can be missed —
    the upstream behaviour).  An id is a regex, as upstream (``unsigned int``,
    ``char *``, ``T<int>``).  Blank ids and ids outside ``_USABLE_ID`` are skipped
    (upstream skips ids that are invalid regexes)."""
    def step(s, i):
        pat = F.concat(F.lit(r"(?U)(^|\W)"), i, F.lit(r"(\W)"))
        ok = (F.length(i) > 0) & i.rlike(_USABLE_ID)
        return F.when(ok, F.regexp_replace(s, pat, F.lit("$1" + token + "$2"))).otherwise(s)
    return F.aggregate(F.coalesce(ids, F.array().cast("array<string>")), body, step)


def _replace_words(body: Column, ids: Column, token: str) -> Column:
    """What ``_replace_ids`` gives, in one pass for ids that are plain words:
    the body is split into words and what lies between, and every word is
    looked up in the list.

    Both forms agree because a word is replaced wherever something follows it,
    but for a word that follows itself after a single character, which the
    pattern consumed with the first; bodies with such a pair, and lists with an
    id twice or one that is no plain word, take the patterns.
    """
    def swap(body, ids):
        words = F.regexp_extract_all(body, F.lit(r"(?U)\w+"), 0)

        def one_pass(x):
            n, ends = F.size(x["words"]), F.element_at(x["gaps"], -1)
            # a word is swapped if anything follows it
            swapped = F.transform(x["words"], lambda w, i: F.concat(F.element_at(x["gaps"], i + 1), F.when(
                F.array_contains(ids, w) & ((i < n - 1) | (ends != "")), F.lit(token)).otherwise(w)))
            return F.when(n > 0, F.concat(F.array_join(swapped, ""), ends)).otherwise(body)

        plain = F.forall(ids, lambda i: i.rlike(r"(?U)^\w+$")) & (F.size(F.array_distinct(ids)) == F.size(ids))
        twins = body.rlike(r"(?U)\b(\w+)\W\1\b")
        parts = F.struct(words.alias("words"), F.split(body, r"(?U)\w+", -1).alias("gaps"))
        return F.when(F.coalesce(F.size(ids), F.lit(0)) < 1, body) \
            .when(plain & ~twins, TX.bind(parts, one_pass)).otherwise(_replace_ids(body, ids, token))

    # the body is the outcome of the lists before: computed once, not at every use
    return TX.bind(F.struct(body.alias("body"), ids.alias("ids")), lambda x: swap(x["body"], x["ids"]))


def abstract_identifiers(body, params=None, dtypes=None, locals_=None) -> Column:
    """T4: parameters -> FPARAM, then data types -> DTYPE, then locals -> LVAR."""
    b = TX._c(body)
    for ids, token in ((params, "FPARAM"), (dtypes, "DTYPE"), (locals_, "LVAR")):
        if ids is not None:
            b = _replace_words(b, TX._c(ids), token)
    return b


def three_forms(fn: DataFrame, params_col=None, dtypes_col=None, locals_col=None) -> DataFrame:
    """T5 + T6 on ``fn(name, path, body, ...)``: ``orig``, ``norm``, ``abst``
    line arrays, ``norm_hash``, ``func_id`` (``name##path`` with ``/`` ->
    ``@@``) and ``dir`` (path minus file name)."""
    body = F.col("body")
    abst_body = abstract_identifiers(body, params_col, dtypes_col, locals_col)
    empty = F.array().cast("array<string>")
    nonblank = F.length(body) > 0
    norm = F.when(nonblank, TX.norm_lines(body)).otherwise(empty)
    abst = F.when(nonblank, TX.norm_lines(abst_body)).otherwise(empty)
    cols = [c for c in fn.columns if c != "body"]
    out = fn.select(*cols, norm.alias("norm"), abst.alias("abst"))
    return out.select(
        F.concat(F.col("name"), F.lit("##"), F.regexp_replace("path", "/", "@@")).alias("func_id"),
        *cols, "norm", "abst", TX.function_hash(F.col("norm")).alias("norm_hash"),
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"))


def _line_bins(start: Column, end: Column) -> Column:
    """Numbers of the bins of ``BIN_LINES`` lines that lines start to end touch."""
    return F.sequence((start / BIN_LINES).cast("int"), (end / BIN_LINES).cast("int"))


def _function_spans(tags: DataFrame, **names) -> DataFrame:
    """Function tags, one row per bin of lines their range touches: the range
    join on the line becomes an equi-join on (path, bin)."""
    cols = {"name": "name", **names}
    spans = tags.where((F.col("kind") == "function") & (F.col("line") <= F.col("end_line"))).select(
        "path", F.col("name").alias(cols["name"]), F.col("line").alias("start_line"), "end_line").distinct()
    return spans.withColumn("bin", F.explode(_line_bins(F.col("start_line"), F.col("end_line"))))


def extract_functions(lines: DataFrame, tags: DataFrame, keep_overloads: bool = False) -> DataFrame:
    """T7 (+J10): one row per function tag with its body.

    ``tags(path, name, kind, line, end_line)``; function bodies are the file
    lines in ``[line, end_line]``.  Lines are gathered into bins of
    ``BIN_LINES``, a function is joined to the bins it touches, and takes its
    lines out of them; so a file of many functions is spread over its bins.
    The body is assembled per function (bounded by function size); a
    duplicate ``name##path`` keeps the last function by line, as upstream.
    """
    bins = lines.groupBy("path", (F.col("line_no") / BIN_LINES).cast("int").alias("bin")).agg(
        F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
    own = F.filter("ls", lambda x: x["line_no"].between(F.col("start_line"), F.col("end_line")))
    j = _function_spans(tags).join(bins, ["path", "bin"]).withColumn("own", own).where(F.size("own") > 0)
    bodies = j.groupBy("path", "name", "start_line", "end_line").agg(
        F.sort_array(F.collect_list(F.struct("bin", "own"))).alias("bs"))
    bodies = bodies.select("path", "name", "start_line", "end_line",
                           F.flatten(F.transform("bs", lambda b: F.transform(b["own"], lambda x: x["text"]))).alias("orig"))
    if keep_overloads:
        # every definition kept; the start line joins the key
        return bodies.select("path", F.concat(F.col("name"), F.lit("@"), F.col("start_line").cast("string"))
                             .alias("name"), "start_line", "end_line", "orig",
                             F.array_join("orig", "\n").alias("body"))
    # last wins per (name, path): keep the max start line (a partial aggregate)
    last = bodies.groupBy("path", "name").agg(F.max(F.struct(
        "start_line", "end_line", "orig")).alias("f"))
    return last.select("path", "name", F.col("f.start_line").alias("start_line"),
                       F.col("f.end_line").alias("end_line"), F.col("f.orig").alias("orig"),
                       F.array_join("f.orig", "\n").alias("body"))


# What the fold over a C-like file looks at, in the order it is tried: preprocessor
# lines, comments, string and character literals, transparent scopes, calls, signs.
_C_TOKENS = (r"(?m:^[ \t]*#(?:\\\r?\n|[^\n])*)", r"//[^\n]*", r"(?s:/\*.*?(?:\*/|\z))", r'"(?:\\[\s\S]|[^"\\\n])*"?', r"'(?:\\[\s\S]|[^'\\\n])*'?",
             r'\bnamespace\b[^;{}()"]*\{', r'\bextern\s*"C"\s*\{', r"[A-Za-z_]\w*\s*\(", r"[(){};\n]")
_NO_FUNCTION = ["__attribute__", "__declspec", "alignas", "asm", "__asm__", "decltype", "_Static_assert", "static_assert"]


def c_functions(content: Column) -> Column:
    """Functions of a C-like file, ``array<struct<name, start_line, end_line>>``,
    by one fold over its tokens.

    The state is the line, the depth of braces and parentheses, and the header
    seen so far.  Braces in strings, character literals, comments and
    preprocessor lines do not count; ``namespace`` and ``extern "C"`` blocks are
    looked into.  A function is a block at depth 0 after a header ``name(...)``
    since the last ``;`` or block; it starts on the name's line, and one that is
    not closed ends with the file.  An approximation, as anything without a
    parser: conditional compilation that opens a brace twice is not undone.
    """
    tokens = F.regexp_extract_all(content, F.lit("|".join(_C_TOKENS)), 0)
    functions = "array<struct<name:string,start_line:int,end_line:int>>"
    text, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    state = ["line", "depth", "paren", "name", "at", "inside", "out"]
    first = F.struct(F.lit(1).alias("line"), F.lit(0).alias("depth"), F.lit(0).alias("paren"), text.alias("name"), number.alias("at"),
                     F.lit(False).alias("inside"), F.array().cast(functions).alias("out"))

    def found(s, end):
        return F.array_append(s["out"], F.struct(s["name"].alias("name"), s["at"].alias("start_line"), end.alias("end_line")))

    def step(s, t):
        def then(**new):
            return F.struct(*[new.get(k, s[k]).alias(k) for k in state])

        top = s["depth"] == 0
        word = F.regexp_extract(t, r"^\w+", 0)
        header = top & (s["paren"] == 0) & s["name"].isNull() & ~word.isin(_NO_FUNCTION)
        closed = F.greatest(s["depth"] - 1, F.lit(0))
        ends = (closed == 0) & s["inside"]
        forget = dict(name=text, at=number)
        return F.when(t == "\n", then(line=s["line"] + 1)) \
            .when((t == ";") & top, then(paren=F.lit(0), **forget)) \
            .when((t == "(") & top, then(paren=s["paren"] + 1)) \
            .when((t == ")") & top, then(paren=F.greatest(s["paren"] - 1, F.lit(0)))) \
            .when(t == "{", then(depth=s["depth"] + 1, inside=s["inside"] | (top & s["name"].isNotNull() & (s["paren"] == 0)))) \
            .when(t == "}", F.when(ends, then(depth=closed, paren=F.lit(0), inside=F.lit(False), out=found(s, s["line"]), **forget))
                  .when(closed == 0, then(depth=closed, paren=F.lit(0), **forget)).otherwise(then(depth=closed))) \
            .when(t.endswith("{"), then(line=s["line"] + TX.newline_count(t), paren=F.lit(0), **forget)) \
            .when(t.endswith("(") & F.rlike(t, F.lit(r"^\w")),
                  F.when(header, then(line=s["line"] + TX.newline_count(t), paren=s["paren"] + 1, name=word, at=s["line"]))
                  .when(top, then(line=s["line"] + TX.newline_count(t), paren=s["paren"] + 1))
                  .otherwise(then(line=s["line"] + TX.newline_count(t)))) \
            .when(t.contains("\n"), then(line=s["line"] + TX.newline_count(t))) \
            .otherwise(s)

    return F.aggregate(tokens, first, step, lambda s: F.when(s["inside"], found(s, F.size(F.split(content, "\n", -1)))).otherwise(s["out"]))


def extract_functions_braces(files: DataFrame) -> DataFrame:
    """T7 without tags: C-like functions of ``files(path, content)`` by a fold
    over each file (``c_functions``), without a shuffle or window.  Numbered
    lines (``path, line_no, text``) are put together to files first.  Same output
    as ``extract_functions``; of functions of one name the last stays.
    """
    if "content" not in files.columns:
        files = files.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("ls")) \
            .select("path", F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("content"))
    found = files.select("path", "content", F.array_sort(c_functions(F.col("content"))).alias("fs"))
    # sorted by name and place: the last of a name precedes another name
    last = F.filter("fs", lambda f, i: F.coalesce(F.get("fs", i + 1)["name"] != f["name"], F.lit(True)))
    each = found.select("path", F.transform(F.split("content", "\n", -1), lambda x: F.regexp_replace(x, r"\r$", "")).alias("lines"),
                        F.explode(last).alias("f"))
    orig = F.slice("lines", F.col("f.start_line"), F.col("f.end_line") - F.col("f.start_line") + 1)
    return each.select("path", "f.name", "f.start_line", "f.end_line", orig.alias("orig"), F.array_join(orig, "\n").alias("body"))


def tags_in_functions(tags: DataFrame) -> DataFrame:
    """Parameter / local tags lying inside a function's line range in the
    same file -> per function the parameter, data-type and local lists.  The
    interval join is one on (path, bin of lines)."""
    inner = tags.where(F.col("kind").isin("parameter", "local")).select(
        "path", (F.col("line") / BIN_LINES).cast("int").alias("bin"), F.col("name").alias("id"), "kind", F.col("line").alias("at"), "typeref")
    j = _function_spans(tags, name="fname").join(inner, ["path", "bin"]).where(F.col("at").between(F.col("start_line"), F.col("end_line")))
    order = F.struct("at", "id", "kind", "typeref")
    g = j.groupBy("path", "fname", "start_line").agg(F.sort_array(F.collect_list(order)).alias("ts"))
    return g.select(
        "path", F.col("fname").alias("name"), "start_line",
        F.transform(F.filter("ts", lambda t: t["kind"] == "parameter"), lambda t: t["id"]).alias("params"),
        # data types in the upstream order: all parameter types, then local types
        F.concat(
            F.transform(F.filter("ts", lambda t: (t["kind"] == "parameter") & t["typeref"].isNotNull()),
                        lambda t: t["typeref"]),
            F.transform(F.filter("ts", lambda t: (t["kind"] == "local") & t["typeref"].isNotNull()),
                        lambda t: t["typeref"])).alias("dtypes"),
        F.transform(F.filter("ts", lambda t: t["kind"] == "local"), lambda t: t["id"]).alias("locals"))


# --- J1 / J2 / J3 / J13 -------------------------------------------------------------

def store_table(df: DataFrame, limit: int | None = None) -> tuple[DataFrame, bool]:
    """Write a store-side table once, from the tasks, and read it back:
    ``(table, is_small)``.  Later jobs scan the written rows instead of
    re-running their lineage; ``is_small`` says whether the written bytes are
    within ``limit`` (``BROADCAST_BYTES``), so the table may be broadcast."""
    table = materialize(df, "store")
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table, size <= (BROADCAST_BYTES if limit is None else limit)


def _side(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def hash_matches(functions: DataFrame, vuln_hash: DataFrame, oss_idx: DataFrame) -> DataFrame:
    """Target functions whose ``norm_hash`` is a known vulnerable hash of an
    OSS present in the OSS index."""
    known = vuln_hash.join(oss_idx.select("oss").distinct(), "oss", "left_semi")
    known, small = store_table(known.select("oss", F.col("hash").alias("norm_hash")).distinct())
    return functions.select("func_id", "dir", "norm_hash").join(_side(known, small), "norm_hash")


def reused_vulns(hits: DataFrame, oss_idx: DataFrame) -> DataFrame:
    """Vulnerability indices of every OSS with at least one hash hit."""
    return oss_idx.join(hits.select("oss").distinct(), "oss", "left_semi").select("vuln_idx").distinct()


def reduce_by_dir(functions: DataFrame, hits: DataFrame) -> DataFrame:
    """All functions whose directory holds at least one hash hit."""
    return functions.join(hits.select("dir").distinct(), "dir", "left_semi")


def label_cve(findings: DataFrame, vuln_cve: DataFrame) -> DataFrame:
    """vuln_idx -> CVE (last row wins upstream; the store keeps one).
    The CVE table grows with the store, so it is broadcast only under the
    checked byte bound."""
    cves, small = store_table(vuln_cve)
    return findings.join(_side(cves, small), "vuln_idx", "left")


# --- J8 / J9 ------------------------------------------------------------------------

def rare_prefixes(bodies: DataFrame, need: Column) -> DataFrame:
    """``bodies(b_id, b)`` with distinct lines ``b`` -> ``(b_id, line)``: of each body its
    ``|b| - need + 1`` rarest lines (by the number of bodies that hold them,
    then text).  A set that shares at least ``need`` lines with the body
    holds one of them (pigeonhole), so the lines most bodies share (``}``,
    ``''``) only enter a join where a body has too few others.  Bodies that
    cannot share ``need`` lines have no row."""
    lines = bodies.select("b_id", F.size("b").alias("s"), need.alias("need"), F.explode("b").alias("line"))
    lines = lines.where(F.col("need") <= F.col("s"))
    freq = lines.groupBy("line").agg(F.count(F.lit(1)).alias("df"))
    # a body is one row: its lines are sorted there, without a window
    ordered = lines.join(freq, "line").groupBy("b_id", "s", "need").agg(
        F.sort_array(F.collect_list(F.struct("df", "line"))).alias("ls"))
    keep = F.least(F.col("s") - F.col("need") + 1, F.col("s")).cast("int")
    return ordered.select("b_id", F.explode(F.slice("ls", 1, keep)).alias("e")).select("b_id", F.col("e.line").alias("line"))


def _sharing_pairs(sets: DataFrame, bodies: DataFrame, need: Column, salt_buckets: int) -> DataFrame:
    """Pairs of ``sets(func_id, x)`` and ``bodies(b_id, b, ...)`` that share a rare line,
    with the exact number ``shared`` of common lines.

    Candidates are pairs of ids from the join on the rare lines; each is
    counted on the two whole sets.  The sets are read again for that, but
    only those with a candidate pass the join on ``func_id``."""
    flines = sets.select("func_id", F.explode("x").alias("line"))
    cand = _line_join(flines, rare_prefixes(bodies, need), ("line",), salt_buckets).select("func_id", "b_id").distinct()
    bodies, small = store_table(bodies)
    j = cand.join(sets, "func_id").join(_side(bodies, small), "b_id")
    return j.withColumn("shared", F.size(F.array_intersect("b", "x")).cast("bigint"))


def containment_pairs(functions: DataFrame, bodies: DataFrame, theta: float = THETA,
                      min_lines: int = 4, salt_buckets: int = SALT_BUCKETS) -> DataFrame:
    """Pairs with ``|V ∩ X| / |V| >= theta`` on distinct lines, ``|V| >= min_lines``,
    which share at least one line.

    ``functions(func_id, norm)``; ``bodies(vuln_idx, which, body array)``
    (``which`` tells the vulnerable from the oldest body).  Returns
    ``func_id, vuln_idx, which, shared, size_v, containment``.
    """
    store = bodies.select(F.struct("vuln_idx", "which").alias("b_id"), F.array_distinct("body").alias("b")) \
        .where((F.size("b") >= min_lines) & (F.size("b") > 0))
    sets = functions.select("func_id", F.array_distinct("norm").alias("x"))
    need = _at_least(F.size("b") * F.lit(theta))
    pairs = _sharing_pairs(sets, store, need, salt_buckets)
    size_v = F.size("b").cast("bigint")
    return (pairs.select("func_id", "b_id.vuln_idx", "b_id.which", "shared", size_v.alias("size_v"),
                         (F.col("shared") / size_v).alias("containment"))
            .where((F.col("containment") >= F.lit(theta)) & (F.col("shared") > 0)))


def _at_least(bound: Column) -> Column:
    """Fewest common lines for a sum of at least ``bound`` (one at least); the
    margin keeps rounding of the product from raising it."""
    return F.greatest(F.ceil(bound - F.lit(1e-9)), F.lit(1)).cast("int")


def jaccard_pairs(a: DataFrame, b: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """J9 as a join: ``a(a_id, lines)`` (the corpus side), ``b(b_id, lines)``
    (the store side); pairs that share at least one line.

    As ``|set(a)| >= inter``, a pair reaches the threshold only if ``inter`` is
    at least ``threshold`` times b's length, so candidates come from b's
    rarest lines and are counted exactly.  The quirky denominator
    ``|set(a)| + |b| - inter`` uses b's length with duplicates unless
    ``strict``.
    """
    sets = a.select(F.col("a_id").alias("func_id"), F.array_distinct("lines").alias("x"))
    distinct = F.array_distinct("lines")
    nb = F.size(distinct) if strict else F.size("lines")
    store = b.select("b_id", distinct.alias("b"), nb.alias("nb")).where(F.size("b") > 0)
    pairs = _sharing_pairs(sets, store, _at_least(F.col("nb") * F.lit(threshold)), SALT_BUCKETS)
    sim = F.col("shared") / (F.size("x") + F.col("nb") - F.col("shared"))
    return (pairs.select(F.col("func_id").alias("a_id"), "b_id", F.col("shared").alias("inter"), sim.alias("jaccard"))
            .where((F.col("jaccard") >= threshold) & (F.col("inter") > 0)))


# --- D1 -----------------------------------------------------------------------------

def vuln_rules(store: dict) -> DataFrame:
    """Per vulnerability: mode flag, abstraction switch and the line sets the
    per-pair rules need.  Built from the (bounded) store tables only.

    ``store`` holds DataFrames ``vuln_body, ess_lines, pat_lines, dep_lines``.
    Absent tables/rows mean empty sets (the upstream state leak across
    vulnerabilities is not reproduced).
    """
    body = store["vuln_body"]
    # _common wins over _minus for the same index
    ess_all = store["ess_lines"]
    has_common = ess_all.where(F.col("kind") == "common").select("vuln_idx").distinct() \
        .withColumn("has_common", F.lit(True))
    ess = ess_all.join(has_common, "vuln_idx", "left").where(
        (F.col("kind") == "common") | F.col("has_common").isNull())
    ess = ess.groupBy("vuln_idx").agg(
        F.array_distinct(F.collect_list(TX.normalize_line("vul_body"))).alias("core_norm"),
        F.array_distinct(F.collect_list(TX.normalize_line("abs_body"))).alias("core_abs"))
    pat = store["pat_lines"].join(body.select("vuln_idx", "vul_body"), "vuln_idx", "left")
    pn = TX.normalize_line("pat_body")
    is_new = ~F.coalesce(F.array_contains(F.col("vul_body"), pn), F.lit(False))
    pat = pat.groupBy("vuln_idx").agg(
        F.array_distinct(F.collect_list(TX.normalize_line("abs_body"))).alias("pat_abs_all"),
        F.array_distinct(F.collect_list(F.when(is_new, pn))).alias("new_pat_raw"),
        F.array_distinct(F.collect_list(F.when(is_new, TX.normalize_line("abs_body")))).alias("new_abs_raw"))
    junk = F.array(F.lit(""), F.lit("{"), F.lit("}"))
    pat = pat.select("vuln_idx", "pat_abs_all",
                     F.array_except("new_pat_raw", junk).alias("new_pat"),
                     F.array_except("new_abs_raw", junk).alias("new_abs_pat"))
    dep = store["dep_lines"]
    dep = dep.groupBy("vuln_idx").agg(*[
        F.array_distinct(F.collect_list(F.when(F.col("origin") == o, TX.strip_comments(c)))).alias(f"{o}_{k}")
        for o in ("vul", "old") for c, k in (("abs_norm_vul", "abs"), ("orig_norm_vul", "nor"))])
    empty = F.array().cast("array<string>")
    r = (body.join(ess, "vuln_idx", "left").join(pat, "vuln_idx", "left").join(dep, "vuln_idx", "left"))
    has_ess = F.coalesce(F.size("core_norm"), F.lit(0)) > 0
    has_pat = F.col("pat_abs_all").isNotNull()
    flag = F.when(has_pat & ~has_ess, 3).when(has_pat, 2).when(has_ess, 1).otherwise(0)
    is_abs = F.when(has_pat & has_ess, ~F.coalesce(
        F.array_sort("pat_abs_all") == F.array_sort("core_abs"), F.lit(False))).otherwise(True)
    fill = lambda c: F.coalesce(F.col(c), empty)
    return r.select(
        "vuln_idx", flag.alias("flag"), is_abs.alias("is_abs"),
        fill("core_norm").alias("core_norm"), fill("core_abs").alias("core_abs"),
        fill("new_pat").alias("new_pat"), fill("new_abs_pat").alias("new_abs_pat"),
        fill("vul_abs").alias("dep_vul_abs"), fill("vul_nor").alias("dep_vul_nor"),
        fill("old_abs").alias("dep_old_abs"), fill("old_nor").alias("dep_old_nor"),
        F.array_distinct(fill("vul_body")).alias("vul_set"),
        F.array_distinct(fill("old_body")).alias("old_set")).where(F.col("flag") > 0)


def _subset(sub: Column, sup: Column) -> Column:
    return F.size(F.array_except(sub, sup)) == 0


def has_all_lines(core: Column, lines: Column) -> Column:
    """Every essential line is among the function's lines (relational
    division as an array predicate on one candidate pair)."""
    return _subset(core, lines)


def has_dependencies(first: Column, fallback: Column, lines: Column) -> Column:
    """All ``vul`` dependency lines present; failing that, all ``old``
    ones when there are any."""
    return _subset(first, lines) | ((F.size(fallback) > 0) & _subset(fallback, lines))


def lacks_patch(new_lines: Column, lines: Column) -> Column:
    """None of the new patch lines is present."""
    return ~F.arrays_overlap(new_lines, lines)


def _line_join(flines: DataFrame, store: DataFrame, keys=("line",), salt_buckets: int = SALT_BUCKETS) -> DataFrame:
    """Join exploded function lines to exploded store lines on ``keys``.

    The store side is broadcast when its written bytes are within
    ``BROADCAST_BYTES``; otherwise both sides are salted so one hot line
    (shared by a third of all functions) spreads over ``salt_buckets`` tasks.
    """
    keys = list(keys)
    store, small = store_table(store)
    if small:
        return flines.join(F.broadcast(store), keys)
    salt = F.pmod(F.xxhash64("func_id"), F.lit(salt_buckets)).cast("int")
    fs = flines.withColumn("salt", salt)
    ss = store.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
    return fs.join(ss, keys + ["salt"]).drop("salt")


# line sets per vulnerability: (name, form used, rules column) by mode
_SETS_ABS = [("core", "abst", "core_abs"), ("dep_vul", "abst", "dep_vul_abs"), ("dep_old", "abst", "dep_old_abs"),
             ("patch", "abst", "new_abs_pat")]
_SETS_NOR = [("core", "norm", "core_norm"), ("dep_vul", "norm", "dep_vul_nor"), ("dep_old", "norm", "dep_old_nor"),
             ("patch", "norm", "new_pat")]
SET_NAMES = ["vul", "old", "core", "dep_vul", "dep_old", "patch"]


def store_line_sets(rules: DataFrame) -> DataFrame:
    """Every line set a pair is tested against, exploded:
    ``vuln_idx, set_id, form, line`` (``set_id`` indexes ``SET_NAMES``).  Containment sets use normalised
    lines; essential / dependency / patch sets use abstract lines when the
    vulnerability is matched in abstract mode (always for mode 3)."""
    sid = {n: i for i, n in enumerate(SET_NAMES)}
    parts = [rules.select("vuln_idx", F.lit(sid["vul"]).alias("set_id"), F.lit("norm").alias("form"),
                          F.explode("vul_set").alias("line")),
             rules.select("vuln_idx", F.lit(sid["old"]).alias("set_id"), F.lit("norm").alias("form"),
                          F.explode("old_set").alias("line"))]
    abstract = F.col("is_abs") | (F.col("flag") == 3)
    for (name, form_a, col_a), (_n, form_n, col_n) in zip(_SETS_ABS, _SETS_NOR):
        parts.append(rules.select(
            "vuln_idx", F.lit(sid[name]).alias("set_id"),
            F.when(abstract, F.lit(form_a)).otherwise(F.lit(form_n)).alias("form"),
            F.explode(F.when(abstract, F.col(col_a)).otherwise(F.col(col_n))).alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def pair_counts(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """Per (function, vulnerability): how many lines of each store set the
    function has.  One map-side join against the store sets and ONE
    partial-aggregated shuffle on the pair; no cross product, no join back
    to the function table."""
    flines = targets.select("func_id", F.explode(F.array(
        F.struct(F.lit("norm").alias("form"), F.array_distinct("norm").alias("ls")),
        F.struct(F.lit("abst").alias("form"), F.array_distinct("abst").alias("ls")))).alias("f")).select(
        "func_id", F.col("f.form").alias("form"), F.explode("f.ls").alias("line"))
    joined = _line_join(flines, store_line_sets(rules), keys=("form", "line"))
    return joined.groupBy("func_id", "vuln_idx").agg(
        *[F.count_if(F.col("set_id") == i).alias(f"n_{n}") for i, n in enumerate(SET_NAMES)])


def evaluate_pairs(counts: DataFrame, rules: DataFrame, theta: float = THETA) -> DataFrame:
    """J8 containment + J5/J6/J7 from the per-set counts: a set is contained
    when its count equals its size, disjoint when its count is zero."""
    sizes = rules.select("vuln_idx", "flag", "is_abs", *[
        F.size(c).alias(f"s_{n}") for n, c in (("vul", "vul_set"), ("old", "old_set"))],
        F.size(F.when(F.col("is_abs") | (F.col("flag") == 3), F.col("core_abs")).otherwise(F.col("core_norm"))).alias("s_core"),
        F.size(F.when(F.col("is_abs") | (F.col("flag") == 3), F.col("dep_vul_abs")).otherwise(F.col("dep_vul_nor"))).alias("s_dep_vul"),
        F.size(F.when(F.col("is_abs") | (F.col("flag") == 3), F.col("dep_old_abs")).otherwise(F.col("dep_old_nor"))).alias("s_dep_old"),
        F.size(F.when(F.col("is_abs") | (F.col("flag") == 3), F.col("new_abs_pat")).otherwise(F.col("new_pat"))).alias("s_patch"))
    sizes, small = store_table(sizes)  # one row per vulnerability
    j = counts.join(_side(sizes, small), "vuln_idx")
    vul_ok = (F.col("s_vul") > 0) & (F.col("n_vul") / F.col("s_vul") >= F.lit(theta))
    old_ok = (F.col("s_old") > 0) & (F.col("n_old") / F.col("s_old") >= F.lit(theta))
    flag = F.col("flag")
    ess_ok = (flag == 3) | (F.col("n_core") == F.col("s_core"))
    dep_ok = (flag == 3) | (F.col("n_dep_vul") == F.col("s_dep_vul")) | (
        (F.col("s_dep_old") > 0) & (F.col("n_dep_old") == F.col("s_dep_old")))
    patch_ok = F.when(flag == 3, (F.col("s_patch") > 0) & (F.col("n_patch") == 0)).when(
        flag == 2, F.col("n_patch") == 0).otherwise(True)
    return (j.where(vul_ok | old_ok)
            .select("vuln_idx", "func_id", "flag", "is_abs", vul_ok.alias("vul_ok"),
                    old_ok.alias("old_ok"), ess_ok.alias("ess_ok"), dep_ok.alias("dep_ok"),
                    patch_ok.alias("patch_ok"))
            .withColumn("ok", F.col("ess_ok") & F.col("dep_ok") & F.col("patch_ok")))


def clone_candidates(functions: DataFrame, store: dict):
    """J1 -> J2 -> J3: ``(rules, targets)``.  The hits are written once; the
    directory list is broadcast only if its bytes allow it; rules are one
    row per vulnerability and stay distributed."""
    hits, _ = store_table(hash_matches(functions, store["vuln_hash"], store["oss_idx"]).select("oss", "dir").distinct())
    reused = reused_vulns(hits, store["oss_idx"])
    dirs, small = store_table(hits.select("dir").distinct())
    targets = functions.join(_side(dirs, small), "dir", "left_semi")
    rules = vuln_rules(store).join(reused, "vuln_idx", "left_semi")
    # bodies of <= 3 lines never match; one row per vulnerability
    return store_table(rules.where(F.size("vul_set") > 3))[0], targets


def prefix_candidates(targets: DataFrame, rules: DataFrame, theta: float = THETA) -> DataFrame:
    """Prefix filtering (set-similarity joins, Chaudhuri et al. 2006; Bayardo
    et al. 2007) for containment ``|V ∩ X| / |V| >= theta`` of the vulnerable
    or the oldest body.  Returns distinct ``(func_id, vuln_idx)``."""
    bodies = rules.select(F.explode(F.array(
        F.struct("vuln_idx", F.lit("vul").alias("which"), F.col("vul_set").alias("b")),
        F.struct("vuln_idx", F.lit("old").alias("which"), F.col("old_set").alias("b")))).alias("x")).select(
        F.struct("x.vuln_idx", "x.which").alias("b_id"), F.col("x.b").alias("b")).where(F.size("b") > 0)
    prefix = rare_prefixes(bodies, _at_least(F.size("b") * F.lit(theta)))
    flines = targets.select("func_id", F.explode(F.array_distinct("norm")).alias("line"))
    joined = _line_join(flines, prefix.select(F.col("b_id.vuln_idx").alias("vuln_idx"), "line").distinct())
    return joined.select("func_id", "vuln_idx").distinct()


def pair_counts_arrays(cand: DataFrame, targets: DataFrame, rules: DataFrame) -> DataFrame:
    """Exact per-set counts for candidate pairs from the function's arrays
    (one join of the candidates with the function table on ``func_id``)."""
    rules, small = store_table(rules)
    j = cand.join(targets.select("func_id", "norm", "abst"), "func_id").join(_side(rules, small), "vuln_idx")
    x, y = F.array_distinct("norm"), F.array_distinct("abst")
    abstract = F.col("is_abs") | (F.col("flag") == 3)
    pick = lambda a, n: F.when(abstract, F.size(F.array_intersect(F.col(a), y))).otherwise(
        F.size(F.array_intersect(F.col(n), x)))
    return j.select("func_id", "vuln_idx",
                    F.size(F.array_intersect("vul_set", x)).cast("bigint").alias("n_vul"),
                    F.size(F.array_intersect("old_set", x)).cast("bigint").alias("n_old"),
                    pick("core_abs", "core_norm").cast("bigint").alias("n_core"),
                    pick("dep_vul_abs", "dep_vul_nor").cast("bigint").alias("n_dep_vul"),
                    pick("dep_old_abs", "dep_old_nor").cast("bigint").alias("n_dep_old"),
                    pick("new_abs_pat", "new_pat").cast("bigint").alias("n_patch"))


def store_fanout(rules: DataFrame) -> int:
    """Most store line sets any one line belongs to."""
    sets = store_line_sets(rules)
    row = sets.groupBy("form", "line").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()
    return int(row[0] or 0)


def rule_checks(functions: DataFrame, store: dict, theta: float = THETA, strategy: str = "auto") -> DataFrame:
    """Candidate pairs (containment of the vulnerable or oldest body) with
    the per-rule outcome ``ess_ok`` (J5), ``dep_ok`` (J6), ``patch_ok``
    (J7) and their conjunction ``ok``.

    ``strategy``: ``counts`` — one inverted join of every function line with
    every store line set, counted per pair (work = corpus lines x fan-out);
    ``prefix`` — candidates by prefix filtering, then exact counts from the
    arrays; ``auto`` picks ``counts`` when the store's fan-out (most sets
    sharing one line) is at most ``MAX_FANOUT``, else ``prefix``."""
    rules, targets = clone_candidates(functions, store)
    if strategy == "auto":
        strategy = "counts" if store_fanout(rules) <= MAX_FANOUT else "prefix"
    if strategy == "counts":
        counts = pair_counts(targets, rules)
    else:
        counts = pair_counts_arrays(prefix_candidates(targets, rules, theta), targets, rules)
    return evaluate_pairs(counts, rules, theta)


def detect_clones(functions: DataFrame, store: dict, theta: float = THETA, strategy: str = "auto") -> DataFrame:
    """One finding per (vulnerability, function).

    ``store`` has ``oss_idx, vuln_cve, vuln_hash, vuln_body, ess_lines,
    pat_lines, dep_lines``.  Returns ``vuln_idx, cve, func_id, name, path,
    matched_on`` (``vul`` or ``old`` body).
    """
    checked = rule_checks(functions, store, theta, strategy).where(F.col("ok"))
    found = checked.select(
        "vuln_idx", "func_id", F.when(F.col("vul_ok"), F.lit("vul")).otherwise(F.lit("old")).alias("matched_on"))
    # names only for the findings: a join on the function key, after filtering
    found = found.join(functions.select("func_id", "name", "path"), "func_id")
    return label_cve(found, store["vuln_cve"]).select("vuln_idx", "cve", "func_id", "name", "path", "matched_on")
