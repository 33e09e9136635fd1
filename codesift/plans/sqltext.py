"""Helpers that render catalogue tables as SQL text for the DuckDB oracles."""

from __future__ import annotations


def q(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], columns: list[str]) -> str:
    """``(VALUES ...) AS t(cols)`` with every column typed by its first value."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, int):
            return str(v)
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return q(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(chr(34) + c + chr(34) for c in columns)}))"


def conf_sql(code: str, plen: str, rule: str) -> str:
    """T11 in DuckDB SQL, additions in the reference's order, as doubles."""
    d = lambda x: f"CAST({x} AS DOUBLE)"
    if rule == "G-vul":
        return (f"least({d(0.7)} + (CASE WHEN strlen({code}) > 10 THEN {d(0.1)} ELSE {d(0)} END)"
                f" + (CASE WHEN contains({code}, 'import') THEN {d(0.1)} ELSE {d(0)} END)"
                f" + (CASE WHEN {plen} > 20 THEN {d(0.1)} ELSE {d(0)} END), {d(1.0)})")
    length = f"length({code})" if rule == "P" else f"strlen({code})"
    imp = f"contains({code}, 'import')"
    if rule == "G-js":
        imp = f"({imp} OR contains({code}, 'require'))"
    s = (f"least({d(0.8)} + (CASE WHEN {length} > 10 THEN {d(0.05)} ELSE {d(0)} END)"
         f" + (CASE WHEN {imp} THEN {d(0.05)} ELSE {d(0)} END)"
         f" + (CASE WHEN {plen} > 20 THEN {d(0.05)} ELSE {d(0)} END)"
         f" + (CASE WHEN contains({code}, '(') AND contains({code}, ')') THEN {d(0.05)} ELSE {d(0)} END),"
         f" {d(1.0)})")
    if rule == "P":
        s = f"round({s}, 2)"
    return s


def all_matches_sql(files: str, patterns: str, extra_cols: str = "") -> str:
    """Every match of every pattern in every file with start/end lines, as a
    SQL subquery: the same interleave of match texts and the gaps between
    them that the Spark side uses, with a running window sum for the lines.

    ``files`` has ``path, content``; ``patterns`` has ``pattern`` + extras.
    """
    return f"""(
  WITH fp AS (
    SELECT f.path, f.content, p.*, regexp_extract_all(f.content, p.pattern) AS ms,
           string_split_regex(f.content, p.pattern) AS gs
    FROM {files} f JOIN {patterns} p ON regexp_matches(f.content, p.pattern)),
  ex AS (
    SELECT fp.* EXCLUDE (ms, gs, content), i, ms[i] AS mtext,
      (length(gs[i]) - length(replace(gs[i], chr(10), '')))
        + (length(ms[i]) - length(replace(ms[i], chr(10), ''))) AS step,
      length(ms[i]) - length(replace(ms[i], chr(10), '')) AS inner_nl,
      length(gs[i]) + length(ms[i]) AS span, length(ms[i]) AS mlen
    FROM fp, range(1, len(ms) + 1) r(i))
  SELECT ex.* EXCLUDE (step, inner_nl, span, mlen),
    CAST(SUM(span) OVER (PARTITION BY path, {", ".join(["pattern"] + ([extra_cols] if extra_cols else []))}
         ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - mlen AS INT) AS "offset",
    CAST(1 + SUM(step) OVER (PARTITION BY path, {", ".join(["pattern"] + ([extra_cols] if extra_cols else []))}
         ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - inner_nl AS INT) AS line_start,
    CAST(1 + SUM(step) OVER (PARTITION BY path, {", ".join(["pattern"] + ([extra_cols] if extra_cols else []))}
         ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS line_end
  FROM ex)"""
