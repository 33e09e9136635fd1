"""Column expressions over code text.

All are built-in Spark SQL expressions or SQL higher-order functions, so they
stay inside whole-stage codegen / the JVM and never ship rows to Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import PYTHON, RE2, to_java


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.  A lambda of a
    higher-order function computes a column again at every place and for
    every element it is used in; a bound value is a variable there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- T1 / T2 / T3 / T6 -----------------------------------------------------

def normalize_line(col) -> Column:
    """Drop ``\\r``, ``\\t`` and spaces, lower-case."""
    return F.lower(F.translate(_c(col), "\r\t ", ""))


def normalize_for_hash(col) -> Column:
    """T1 plus drop ``\\n``, ``{`` and ``}``."""
    return F.lower(F.translate(_c(col), "\n\r\t{} ", ""))


# One Java pattern; group 3 is the non-comment text.  String literals are
# written in unrolled form so long literals cannot overflow the regex stack.
STRIP_COMMENTS_PATTERN = (
    r"(?dsm)(//.*?$|[{}]+)|(/\*.*?\*/)|"
    r"('[^\\']*(?:\\.[^\\']*)*'|\"[^\\\"]*(?:\\.[^\\\"]*)*\"|.[^/'\"]*)"
)


def strip_comments(col) -> Column:
    """Remove ``//`` and ``/* */`` comments and brace runs at token
    starts, keep string literals and newlines."""
    return F.regexp_replace(_c(col), STRIP_COMMENTS_PATTERN, "$3")


def function_hash(norm_lines) -> Column:
    """md5 of T2 over the concatenated normalised lines."""
    return F.md5(normalize_for_hash(F.array_join(_c(norm_lines), "")))


def norm_lines(body) -> Column:
    """T5 ``norm`` form: T1 on each line of T3(body)."""
    return F.transform(F.split(strip_comments(body), "\n", -1), lambda x: normalize_line(x))


# --- T9 / T10: match positions --------------------------------------------

def newline_count(col) -> Column:
    c = _c(col)
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def all_matches(content, java_pattern: str | Column) -> Column:
    """Every non-overlapping match of ``java_pattern`` (also a column) in ``content``:
    ``array<struct<idx, text, line_start, line_end, offset>>`` with 1-based
    lines and the 0-based character offset of the match start.

    Spark has no all-positions regex function, so the match texts
    (``regexp_extract_all``) are interleaved with the text between matches
    (``split`` on the same pattern): the newlines before match ``i`` are those
    in gaps ``0..i`` and matches ``0..i-1``.  One left-to-right ``aggregate``
    carries the running line and offset.  The pattern must not match the
    empty string (rejected on load).
    """
    c = _c(content)
    m = F.regexp_extract_all(c, F.lit(java_pattern), 0)  # lit() leaves a column as it is
    s = F.split(c, java_pattern, -1)
    steps = F.zip_with(m, s, lambda mt, gap: F.struct(
        newline_count(gap).alias("g"), newline_count(mt).alias("t"), F.length(gap).alias("gl"),
        F.length(mt).alias("tl"), mt.alias("text")))
    steps = F.slice(steps, 1, F.size(m))
    init = F.struct(F.lit(1).alias("line"), F.lit(0).alias("off"), F.array().cast(
        "array<struct<idx:int,text:string,line_start:int,line_end:int,offset:int>>").alias("out"))

    def step(acc, x):
        start = acc["line"] + x["g"]
        end = start + x["t"]
        off = acc["off"] + x["gl"]
        rec = F.struct((F.size(acc["out"]) + 1).cast("int").alias("idx"), x["text"].alias("text"),
                       start.cast("int").alias("line_start"), end.cast("int").alias("line_end"),
                       off.cast("int").alias("offset"))
        return F.struct(end.alias("line"), (off + x["tl"]).alias("off"),
                        F.array_append(acc["out"], rec).alias("out"))

    return F.aggregate(steps, init, step, lambda acc: acc["out"])


def context_snippet(lines_arr, line_start, line_end, n: int = 3) -> Column:
    """Lines ``[start-n, end+n]`` clipped to the file, joined by ``\\n``."""
    lo = F.greatest(F.lit(0), _c(line_start) - n - 1)
    hi = F.least(F.size(_c(lines_arr)), _c(line_end) + n)
    return F.array_join(F.slice(_c(lines_arr), lo + 1, F.greatest(hi - lo, F.lit(0))), "\n")


# --- T11: confidence rules --------------------------------------------------

def confidence(code, pattern_len, rule: str) -> Column:
    """T11.  ``pattern_len`` is the (fixed) length of the pattern text.

    P     Python: .8 + .05 (len>10, 'import', pattern>20, '(' and ')'), cap 1, round 2
    G-py  Go line detector: as P with byte length, no rounding
    G-js  as G-py, 'require' also counts as import
    G-vul Go signature detector: .7 + .1 (len>10, 'import', pattern>20), cap 1
    Additions are made in the reference's order so doubles agree bit for bit.
    """
    code = _c(code)
    plen = _c(pattern_len) if not isinstance(pattern_len, int) else F.lit(pattern_len)
    zero = F.lit(0.0)
    if rule == "G-vul":
        conf = (F.lit(0.7)
                + F.when(F.octet_length(code) > 10, F.lit(0.1)).otherwise(zero)
                + F.when(code.contains("import"), F.lit(0.1)).otherwise(zero)
                + F.when(plen > 20, F.lit(0.1)).otherwise(zero))
        return F.least(conf, F.lit(1.0))
    length = F.length(code) if rule == "P" else F.octet_length(code)
    has_import = code.contains("import")
    if rule == "G-js":
        has_import = has_import | code.contains("require")
    conf = (F.lit(0.8)
            + F.when(length > 10, F.lit(0.05)).otherwise(zero)
            + F.when(has_import, F.lit(0.05)).otherwise(zero)
            + F.when(plen > 20, F.lit(0.05)).otherwise(zero)
            + F.when(code.contains("(") & code.contains(")"), F.lit(0.05)).otherwise(zero))
    conf = F.least(conf, F.lit(1.0))
    if rule == "P":
        conf = F.round(conf, 2)
    return conf


RULE_DIALECT = {"P": PYTHON, "G-py": RE2, "G-js": RE2, "G-vul": RE2}


def java_for_rule(pattern: str, rule: str, **kw) -> str:
    return to_java(pattern, RULE_DIALECT[rule], **kw)


# --- T8: semantic hash --------------------------------------------------------

_IDENT = r"(?U)\b[a-zA-Z_]\w*\b"


def semantic_form(col) -> Column:
    """T8 before hashing: strip ``#``, ``//``, ``/* */`` comments, collapse
    whitespace, trim, blank string literals, rename identifiers to
    ``var0, var1, ...`` in first-seen order."""
    c = _c(col)
    c = F.regexp_replace(c, r"(?dm)#.*$", "")
    c = F.regexp_replace(c, r"(?dm)//.*$", "")
    c = F.regexp_replace(c, r"(?s)/\*.*?\*/", "")
    c = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    c = F.regexp_replace(c, r'"[^"]*"', '""')
    c = F.regexp_replace(c, r"'[^']*'", "''")

    def rename(x):
        body = F.array_join(F.transform(x["ids"], lambda t, i: F.concat(
            F.element_at(x["gaps"], i + 1), F.lit("var"), (F.array_position(x["uniq"], t) - 1).cast("string"))), "")
        return F.concat(body, F.element_at(x["gaps"], -1))

    ids = lambda c: F.struct(F.regexp_extract_all(c, F.lit(_IDENT), 0).alias("ids"), F.split(c, _IDENT, -1).alias("gaps"))
    return bind(c, lambda c: bind(ids(c), lambda x: bind(
        F.struct(x["ids"].alias("ids"), x["gaps"].alias("gaps"), F.array_distinct(x["ids"]).alias("uniq")), rename)))


def semantic_hash(col) -> Column:
    return F.sha2(semantic_form(col), 256)


# --- J9 / J14: similarity -------------------------------------------------------

def jaccard(a, b, strict: bool = False) -> Column:
    """J9.  Reference quirk: denominator ``|set(a)| + |b| - inter`` with ``b``
    keeping duplicates.  ``strict=True`` gives the textbook Jaccard."""
    a, b = _c(a), _c(b)
    inter = F.size(F.array_intersect(a, b))
    if strict:
        denom = F.size(F.array_union(a, b))
    else:
        denom = F.size(F.array_distinct(a)) + F.size(b) - inter
    return F.when(denom > 0, inter / denom)


def lcs_length(a, b) -> Column:
    """Length of the longest common subsequence of two strings (J14), as a
    dynamic programme over SQL arrays: the outer ``aggregate`` carries the
    previous DP row, the inner one builds the next."""
    a, b = _c(a), _c(b)
    n = F.length(b)
    ca = F.split(a, "", -1)
    cb = F.split(b, "", -1)
    # ``split(x, '')`` of a non-empty string yields its characters
    first = F.array_repeat(F.lit(0), n + 1)

    def outer(prev, ch):
        def inner(row, j):
            up = F.element_at(prev, j + 1)
            diag = F.element_at(prev, j)
            left = F.element_at(row, -1)
            val = F.when(F.element_at(cb, j) == ch, diag + 1).otherwise(F.greatest(up, left))
            return F.array_append(row, val)
        return F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(0)), inner)

    res = F.aggregate(ca, first, outer)
    return F.when((F.length(a) == 0) | (n == 0), F.lit(0)).otherwise(F.element_at(res, -1))


def lcs_similarity(a, b) -> Column:
    """LCS / max(len a, len b); 0 when both are empty."""
    a, b = _c(a), _c(b)
    mx = F.greatest(F.length(a), F.length(b))
    return F.when(mx == 0, F.lit(0.0)).otherwise(lcs_length(a, b) / mx)
