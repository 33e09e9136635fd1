"""Regex dialects and pattern validation.

Spark evaluates ``java.util.regex``.  Signatures are written for Python ``re``
or Go RE2; these helpers translate the flags so the same pattern text finds
the same matches:

* ``(?d)`` (UNIX_LINES) in both: ``.``, ``^`` and ``$`` treat only ``\\n`` as a
  line end, as Python and RE2 do.
* Python ``\\w \\s \\b \\d`` are Unicode -> ``(?U)``; RE2's are ASCII -> no flag.
* Python ``re.IGNORECASE`` on str patterns is Unicode-aware -> ``(?iu)``.

Patterns are validated before they are used, a table of them in the tasks
(``with_reasons``); invalid ones and ones that can match the empty string go to a rejects
table instead of failing the job.  RE2 has no look-around or back-references:
such patterns are flagged ``re2_ok = false`` so the Go-compatible detectors
skip them as the reference does, unless asked to keep them.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PYTHON = "python"
RE2 = "re2"

_LOOKAROUND = re.compile(r"\(\?<?[=!]|\\[1-9]")


def to_java(pattern: str, dialect: str = RE2, ignore_case: bool = False, multiline: bool = False) -> str:
    flags = "d"
    if dialect == PYTHON:
        flags += "U"
    if ignore_case:
        flags += "iu"
    if multiline:
        flags += "m"
    return f"(?{flags}){pattern}"


def re2_compatible(pattern: str) -> bool:
    """False for constructs RE2 rejects (look-around, back-references)."""
    return _LOOKAROUND.search(pattern) is None


def is_re2_compatible(pattern: Column) -> Column:
    """``re2_compatible`` of a column."""
    return ~F.rlike(pattern, F.lit(_LOOKAROUND.pattern))


def check_pattern(spark, pattern: str, dialect: str = RE2) -> str | None:
    """Return ``None`` if usable, else the reason it is rejected.

    Compiles with the JVM's own regex engine, i.e. the one the scan uses.
    """
    if pattern is None or pattern == "":
        return "empty pattern"
    jvm = spark.sparkContext._jvm
    try:
        compiled = jvm.java.util.regex.Pattern.compile(to_java(pattern, dialect))
    except Exception as exc:  # py4j wraps PatternSyntaxException
        return f"invalid: {str(exc).splitlines()[0][:200]}"
    for probe in ("", "x", "\n"):
        m = compiled.matcher(probe)
        if m.find() and m.end() == m.start():
            return "matches the empty string"
    bare = _without_lookaround(pattern)
    if bare != pattern:
        try:
            if jvm.java.util.regex.Pattern.compile(to_java(bare, dialect)).matcher("").find():
                return "matches the empty string"
        except Exception:  # the rest alone is no pattern: judged by the probes only
            pass
    return None


def _without_lookaround(pattern: str) -> str:
    """``pattern`` without its look-around groups, which consume nothing."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        if pattern[i] == "\\":
            out.append(pattern[i:i + 2])
            i += 2
        elif not in_class and pattern.startswith(("(?=", "(?!", "(?<=", "(?<!"), i):
            depth = 0
            while i < len(pattern):
                step = 2 if pattern[i] == "\\" else 1
                depth += (pattern[i] == "(") - (pattern[i] == ")")
                i += step
                if depth == 0:
                    break
        else:
            in_class = pattern[i] == "[" or (in_class and pattern[i] != "]")
            out.append(pattern[i])
            i += 1
    return "".join(out)


def with_reasons(patterns: DataFrame, dialect: str = RE2, column: str = "pattern") -> DataFrame:
    """``patterns`` with a column ``reason``: why a pattern is rejected, else
    null, as ``check_pattern`` says of one.  It is decided in the tasks by the
    regex engine of the scan, so a table of any size may be checked."""
    compiled = lambda p: F.call_function("try_reflect", F.lit("java.util.regex.Pattern"), F.lit("compile"), p)
    flags = to_java("", dialect)
    never = F.lit("(?!)")  # in place of what does not compile: such a column pattern would end the job

    @F.arrow_udf("string")
    def bare(ps: pa.Array) -> pa.Array:
        return pa.array([p and _without_lookaround(p) for p in ps.to_pylist()], pa.string())

    def finds_nothing_at(safe: Column, probe: str) -> Column:
        return F.rlike(F.lit(probe), safe) & (F.call_function("regexp_extract", F.lit(probe), safe, F.lit(0)) == "")

    p = F.col(column)
    d = patterns.withColumn("_safe", compiled(F.concat(F.lit(flags), p))).withColumn("_bare", bare(p))
    d = d.withColumn("_safe_bare", F.when(F.col("_bare") != p, compiled(F.concat(F.lit(flags), F.col("_bare")))))
    d = d.select("*", F.coalesce("_safe", never).alias("_s"), F.coalesce("_safe_bare", never).alias("_b"))
    empty = finds_nothing_at(F.col("_s"), "") | finds_nothing_at(F.col("_s"), "x") | finds_nothing_at(F.col("_s"), "\n") | \
        (F.col("_safe").isNotNull() & F.rlike(F.lit(""), F.col("_b")))
    reason = F.when(p.isNull() | (p == ""), "empty pattern").when(F.col("_safe").isNull(), "invalid: the pattern does not compile") \
        .when(empty, "matches the empty string")
    return d.select(*patterns.columns, reason.alias("reason"))


_META = set(".^$*+?{}[]()|\\")
_ESCAPABLE_LITERAL = set("./()[]{}*+?|^$-:'\"=,#&%@!<>~`;")


def required_literal(pattern: str, min_len: int = 3) -> str | None:
    """A literal every match must contain, read from the pattern's leading
    run of plain characters (``\\.`` counts as ``.``), or ``None``.

    Used as a cheap ``contains`` prefilter in front of the regex: exact,
    because a match of the whole pattern starts with that run.  Patterns
    with inline flags, a top-level alternation or an optional last
    character in the run give ``None``.
    """
    if pattern.startswith("(?") or _has_top_level_alternation(pattern):
        return None
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern) and pattern[i + 1] in _ESCAPABLE_LITERAL:
            out.append(pattern[i + 1])
            i += 2
            continue
        if ch in _META:
            break
        out.append(ch)
        i += 1
    if i < len(pattern) and pattern[i] in "?*{" and out:
        out.pop()  # the last character may be optional / repeated zero times
    lit = "".join(out)
    return lit if len(lit) >= min_len else None


def _has_top_level_alternation(pattern: str) -> bool:
    depth, i = 0, 0
    in_class = False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            if ch == "]":
                in_class = False
        elif ch == "[":
            in_class = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "|" and depth == 0:
            return True
        i += 1
    return False
