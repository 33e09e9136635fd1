"""Synthetic code corpus over the driver's ``lineitem`` table.

The driver tables hold no source code, so every scan runs on a corpus derived
from ``lineitem``: one file per ``l_orderkey``, one line per lineitem row, the
line text chosen by a ``CASE`` over integer columns.  The expression strings
below are plain SQL that Spark and DuckDB evaluate identically, so each Spark
operator has a DuckDB oracle over the very same corpus.  The corpus grows
linearly with the scale factor.

Spark shape: one shuffle on ``l_orderkey`` (the file key) that sorts each
file's lines; lines and files are both derived from that one grouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX

LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]

# Order of a file's lines ((l_orderkey, l_linenumber) is not unique).
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
              "l_quantity", "l_discount", "l_tax"]

PATH_SQL = ("CONCAT('src/m', CAST(l_orderkey % 50 AS STRING), '/f', CAST(l_orderkey AS STRING), "
            "CASE WHEN l_orderkey % 5 = 0 THEN '.js' ELSE '.py' END)")

# Fourteen line templates; the ones carrying l_suppkey / l_linenumber vary.
TEXT_SQL = """CASE CAST((l_partkey + l_linenumber) % 14 AS INT)
    WHEN 0 THEN CONCAT('os.system(cmd', CAST(l_suppkey AS STRING), ')')
    WHEN 1 THEN 'subprocess.call(args, shell=True)'
    WHEN 2 THEN 'cursor.execute("SELECT * FROM t WHERE id = %s" % uid)'
    WHEN 3 THEN CONCAT('password = "pw', CAST(l_suppkey AS STRING), '"')
    WHEN 4 THEN 'x = eval(src)'
    WHEN 5 THEN 'import os'
    WHEN 6 THEN 'value = random.randint(1, 6)'
    WHEN 7 THEN 'except:'
    WHEN 8 THEN 'data = pickle.loads(blob)'
    WHEN 9 THEN 'h = hashlib.md5(b)  // weak'
    WHEN 10 THEN 'console.log(value)'
    WHEN 11 THEN 'node.innerHTML = value'
    WHEN 12 THEN CONCAT('total = total + ', CAST(l_linenumber AS STRING))
    ELSE 'return total' END"""


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*LINEITEM_COLS)


def syn_files(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """``files``: ``file_id, path, lines array<string>, content, n_lines``.

    The rows are dealt by the file key first, as they were read, and put together
    to files behind that one shuffle: a ``collect_list`` before it would sort and
    spill whole input splits without making them smaller, and texts and paths
    follow from the columns.  A file is the scanner's atomic unit (the reference reads
    each file whole); at production scale files come from ``scan_corpus``
    (one row per file, no shuffle at all).
    """
    li = source if source is not None else lineitem(spark, sf_dir)
    keyed = li.repartition("l_orderkey").select(
        F.col("l_orderkey").alias("file_id"),
        F.struct(*[F.col(c) for c in LINE_ORDER], F.expr(TEXT_SQL).alias("text")).alias("ln"))
    grouped = keyed.groupBy("file_id").agg(F.sort_array(F.collect_list("ln")).alias("lns"))
    # the lines are computed once for their three uses
    files = grouped.select("file_id", F.expr(PATH_SQL.replace("l_orderkey", "file_id")).alias("path"),
                           F.transform("lns", lambda x: x["text"]).alias("lines"))
    return files.select("file_id", "path", "lines", F.array_join("lines", "\n").alias("content"),
                        F.size("lines").alias("n_lines"))


def syn_lines(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    """``lines``: ``file_id, line_no int, path, text`` (S5 over the files)."""
    files = files if files is not None else syn_files(spark, sf_dir)
    return files.select("file_id", "path", F.posexplode("lines").alias("pos", "text")).select(
        "file_id", (F.col("pos") + 1).cast("int").alias("line_no"), "path", "text")


def syn_functions(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    """``functions``: one function per file, with the three forms (T5), its
    hash (T6) and directory.  Locals for abstraction (T4) are the names the
    function assigns to (the role ctags ``local`` tags play upstream)."""
    files = files if files is not None else syn_files(spark, sf_dir)
    from ..operators import clones
    fn = files.select(
        F.concat(F.lit("f"), F.col("file_id").cast("string")).alias("name"),
        "path", "file_id", F.col("lines").alias("orig"), F.col("content").alias("body"))
    return clones.three_forms(fn, locals_col=assigned_names(F.col("body")))


def assigned_names(body) -> "F.Column":
    """Names assigned with ``name = ...`` in a body, first-seen order."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?m)^\s*([A-Za-z_]\w*)\s*=[^=]"), 1))


# --- DuckDB oracle text (same expressions) ----------------------------------------

def oracle_lines_sql() -> str:
    order = ", ".join(LINE_ORDER)
    return f"""syn_lines AS (
  SELECT l_orderkey AS file_id,
    CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {order}) AS INT) AS line_no,
    {PATH_SQL} AS path,
    {TEXT_SQL} AS text
  FROM lineitem)"""


def oracle_files_sql() -> str:
    return oracle_lines_sql() + """,
syn_files AS (
  SELECT file_id, path, string_agg(text, chr(10) ORDER BY line_no) AS content,
         list(text ORDER BY line_no) AS lines, CAST(count(*) AS INT) AS n_lines
  FROM syn_lines GROUP BY file_id, path)"""


def syn_c_files(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    """A C-style view of the corpus: each file becomes one function
    ``int f<id>(int a)`` whose body is the file's lines as statements — for
    the tag-free function extraction (brace depth).  ``path, content``."""
    files = files if files is not None else syn_files(spark, sf_dir)
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("    "), x, F.lit(";"))), "\n")
    return files.select(
        F.regexp_replace("path", r"\.(py|js)$", ".c").alias("path"),
        F.concat(F.lit("int f"), F.col("file_id").cast("string"), F.lit("(int a)\n{\n"), body,
                 F.lit("\n}\n")).alias("content"))


# A module: a fixed header, then one function of six lines per corpus line.
MODULE_HEAD = ['"""Module of {k}."""', "import sys as system", "from json import loads as parse, dumps", "LIMIT = {n}", "NAMES = ['a', {n}]", "",
               "@register", "@app.route('/{k}')", "class Base{k}(object, Mixin):", '    """Base of {k}."""', "    def __init__(self, size):",
               "        self.size = size", "    @staticmethod", "    def load(path) -> str:", "        kind = 'text'", "        return open(path).read()", ""]
MODULE_BODY = """CASE WHEN text = 'except:' THEN CONCAT('    try:', chr(10), '        pass', chr(10), '    except:', chr(10), '        pass')
    ELSE CONCAT('    ', text, chr(10), '    answer = input("q")', chr(10), '    page = session.get(key)', chr(10), '    return a') END"""
MODULE_FUNCTION = f"""CONCAT('def run_', CAST(n AS STRING), '(a, b):', chr(10), '    \"\"\"Step.\"\"\"', chr(10), {MODULE_BODY})"""


def syn_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole Python files: module, class and function docstrings, decorators, a
    class with methods, imports, and one function per corpus line that holds
    the line as a statement (``except:`` as a whole ``try``).  ``path, content``."""
    files = syn_files(spark, sf_dir)
    key = F.col("file_id").cast("string")
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{k}"), key), F.lit("{n}"), F.col("n_lines").cast("string"))
    steps = F.expr(f"transform(transform(lines, (text, i) -> struct(text, i + 1 AS n)), x -> {MODULE_FUNCTION.replace('text', 'x.text').replace('CAST(n AS', 'CAST(x.n AS')})")
    return files.select(F.regexp_replace("path", r"\.js$", ".py").alias("path"),
                        F.concat(fill("\n".join(MODULE_HEAD) + "\n"), F.array_join(steps, "\n"), F.lit("\n")).alias("content"))


# Two lines for each corpus line, by its number: calls in strings, comments and
# raw strings of two lines beside real ones.
GO_SQL = """CASE CAST(n % 4 AS INT)
    WHEN 0 THEN CONCAT('s := "fmt.Scan(x)" // exec.Command(y)', chr(10), 'if (ok) { go_on(s) }')
    WHEN 1 THEN CONCAT('fmt.Scanln(&v)', chr(10), '/* os.Exit(1) */')
    WHEN 2 THEN CONCAT('r := `os.Remove(', chr(10), '  a(b)`')
    ELSE CONCAT('out := exec.Command(name, os.Getenv(key))', chr(10), '"f(" // c(') END"""


def syn_go_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Go files of two lines per corpus line after ``package`` and ``func main``.
    ``path, content``."""
    steps = F.array_join(F.expr(f"transform(sequence(1, n_lines), n -> {GO_SQL})"), "\n")
    return syn_files(spark, sf_dir).select(F.regexp_replace("path", r"\.(py|js)$", ".go").alias("path"),
                                           F.concat(F.lit("package main\nfunc main() {\n"), steps, F.lit("\n}\n")).alias("content"))


BRACED_SQL = """CASE CAST(n % 6 AS INT)
    WHEN 0 THEN '    s = "{";'
    WHEN 1 THEN '    if (a) { b(); } // }'
    WHEN 2 THEN '    /* { */ c = \\'}\\';'
    WHEN 3 THEN '    s = "a\\\\"}";'
    WHEN 4 THEN '    for (;;) { break; }'
    ELSE '    d = 1;' END"""


def syn_braced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C files with two functions each, one of as many statements as the
    corpus file has lines, with braces inside strings, character literals,
    comments and a macro, and a header of two lines.  ``path, content``."""
    files = syn_files(spark, sf_dir)
    line = F.expr(f"transform(sequence(1, n_lines), n -> {BRACED_SQL})")
    name = lambda f: F.concat(F.lit(f), F.col("file_id").cast("string"))
    return files.select(
        F.regexp_replace("path", r"\.(py|js)$", ".c").alias("path"),
        F.concat(F.lit("#define OPEN(x) { x(\n/* { f( */ struct s { int a; };\n__attribute__((cold))\nint "), name("f"),
                 F.lit("(int a,\n  int b)\n{"), F.lit("\n"), F.array_join(line, "\n"), F.lit("\n}\nint x = 1;\nint "), name("g"),
                 F.lit("(void) { return h(1); }\n")).alias("content"))


def syn_c_functions(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    """Functions of the C view, extracted by brace depth (no tags), with the
    three forms; locals are the assigned names, as for ``syn_functions``."""
    from ..operators import clones
    fns = clones.extract_functions_braces(syn_c_files(spark, sf_dir, files))
    fns = fns.select("name", "path", "body",
                     F.regexp_extract("name", r"^f(\d+)$", 1).cast("long").alias("file_id"))
    return clones.three_forms(fns, locals_col=assigned_names(F.col("body")))


def oracle_c_files_sql() -> str:
    """``syn_cfuncs``: the C view's function bodies (file content without the
    final newline — the brace extraction's span) in ``oracle_functions_sql``'s
    input shape (needs ``syn_files``)."""
    body = ("'int f' || CAST(file_id AS VARCHAR) || '(int a)' || chr(10) || '{' || chr(10) || "
            "array_to_string(list_transform(lines, lambda x: '    ' || x || ';'), chr(10)) || chr(10) || '}'")
    return f"""syn_cfuncs AS (
  SELECT file_id, regexp_replace(path, '\\.(py|js)$', '.c') AS path, {body} AS content,
         []::VARCHAR[] AS lines
  FROM syn_files)"""
