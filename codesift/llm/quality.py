"""Quality rules with adaptive thresholds.

Every document gets a few integer measures.  Their distribution is kept, per
language and source, in a mergeable quantile sketch: a histogram over
logarithmic buckets, whose merge is the sum of the counts.  A rule's limit is
an outlier fence (quartile plus three spreads) read from the sketch of the
document's own language and source, so no cutoff is fixed for all.  It is drawn
toward the language's by the weight of ``PRIOR`` documents, and that toward the
whole corpus' likewise, so a small group's few documents decide little and no
group's size is a switch.  The limits are joined back to decide.

Defined results: a null or empty text has no words, zero measures, and fails
the base rule; null languages and sources are groups of their own; repeated
rows are measured one by one; an empty table gives an empty result; further
columns are kept by ``filter_quality`` and ignored by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns, text_slices, written

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
DROP_FOR_CHARS = SPACE + bytes(range(0x80, 0xC0))
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

# Per measure: least spread assumed between quartiles, and which sides reject.
# The least spread keeps a group of near-equal documents from rejecting
# harmless deviations; it decides where most documents of a group measure
# nothing.  Ratios are per mille of words or lines; word length is in
# hundredths of a character.
RULES = {
    "symbols": (20, "high"),
    "dup_lines": (70, "high"),
    "repeats": (40, "high"),
    "word_length": (60, "both"),
}
FENCE = 3
# Documents whose weight the wider group's limits have in a group's.
PRIOR = 200


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur at least twice."""
    n = len(ids) - 2
    if n < 2:
        return 0
    if ids.max() < 1 << 21:
        key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        pair = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True)[1]
        key = (pair[:-1] << 32) | ids[2:]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, key)
    hit = twice[np.minimum(at, len(twice) - 1)] == key
    covered = np.zeros(n + 2, bool)
    for j in range(3):
        covered[j:n + j] |= hit
    return int(covered.sum())


def measures_of(text: bytes | None) -> tuple:
    if not text:
        return (0,) * len(MEASURES)
    words = text.split()
    if not words:
        return (0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0, 0)
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return (len(words), len(text.translate(None, DROP_FOR_CHARS)),
            len(text) - len(text.translate(None, SYMBOLS)),
            len(lines), len(lines) - len(set(lines)), repeated_words(ids))


def measure_udf():
    fields = ", ".join(f"{m}: bigint" for m in MEASURES)

    @F.arrow_udf(f"struct<{fields}>")
    def measure(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in it:
            rows = [measures_of(t) for _, texts in text_slices(column) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))],
                                             MEASURES)
    return measure


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def ratios(prefix: str = "") -> dict[str, str]:
    """SQL of the measures that have adaptive limits."""
    p = prefix
    return {
        "symbols": f"{p}n_symbols * 1000 div greatest({p}n_words, 1)",
        "dup_lines": f"{p}n_dup_lines * 1000 div greatest({p}n_lines, 1)",
        "repeats": f"{p}n_repeat_words * 1000 div greatest({p}n_words, 1)",
        "word_length": f"{p}word_chars * 100 div greatest({p}n_words, 1)",
    }


def bucket(v: str) -> str:
    """Sketch bucket of a value: exact below 64, then 16 per power of two."""
    return (f"if({v} < 64, {v}, 16 * (length(bin({v})) - 7) + 48"
            f" + shiftright({v}, length(bin({v})) - 5))")


def bucket_value(b: Column) -> Column:
    """Least value of a bucket."""
    step = (b - 64)
    power = F.floor(step / 16).cast("int")
    return F.when(b < 64, b).otherwise(F.expr("shiftleft(cast(16 + pmod(_bucket - 64, 16) as bigint),"
                                              " cast(floor((_bucket - 64) / 16) as int) + 2)"))


def sketches(measured: DataFrame) -> DataFrame:
    """One row per (lang, source, rule, bucket) with its count, over documents
    that pass the base rule.  Sketches merge by adding counts."""
    r = ratios()
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.expr(bucket(f"({sql})")).cast("long").alias("_bucket"))
                                for k, sql in r.items()]))
    return (measured.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
            .select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.rule", "p._bucket")
            .agg(F.count(F.lit(1)).alias("n")))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Limits per group of ``keys`` after merging the sketches of each group."""
    merged = sketch.groupBy(*keys, "rule", "_bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rule")
    cum = merged.withColumn("_c", F.sum("n").over(group.orderBy("_bucket"))) \
        .withColumn("_n", F.sum("n").over(group)) \
        .withColumn("_v", bucket_value(F.col("_bucket")))
    quart = cum.groupBy(*keys, "rule").agg(
        F.max("_n").alias("n"),
        F.min(F.when(4 * F.col("_c") >= F.col("_n"), F.col("_v"))).alias("q1"),
        F.min(F.when(2 * F.col("_c") >= F.col("_n"), F.col("_v"))).alias("q2"),
        F.min(F.when(4 * F.col("_c") >= 3 * F.col("_n"), F.col("_v"))).alias("q3"),
        F.min(F.when(10 * F.col("_c") >= 9 * F.col("_n"), F.col("_v"))).alias("d9"))
    out = []
    for rule, (least, sides) in RULES.items():
        here = F.col("rule") == rule
        # of a measure that is mostly nothing the quartiles say little, and
        # its upper tenth may be all junk: the tail counts for repeats alone
        tail = F.col("d9") - F.col("q2") if rule == "repeats" else F.lit(0)
        spread = F.greatest(F.col("q3") - F.col("q1"), tail, F.lit(least))
        out.append(F.max(F.when(here, F.col("q3") + FENCE * spread)).alias(f"{rule}_high"))
        if sides == "both":
            out.append(F.max(F.when(here, F.col("q1") - FENCE * spread)).alias(f"{rule}_low"))
    return quart.groupBy(*keys).agg(F.max("n").alias("n_docs"), *out)


def limits(measured: DataFrame) -> DataFrame:
    """Limits for every (lang, source) that occurs: its own sketch's, drawn
    toward its language's, those drawn toward the corpus'."""
    sketch = written(sketches(measured), "sketch")
    own = fences(sketch, ["lang", "source"])
    by_lang = fences(sketch, ["lang"])
    whole = fences(sketch.withColumn("_all", F.lit(1)), ["_all"])     # one row, or none
    names = [c for c in own.columns if c not in ("lang", "source", "n_docs")]
    groups = measured.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_rows"))
    o, b = own.alias("o"), by_lang.alias("b")
    g = groups.withColumn("w", whole.select(F.struct(*names)).scalar()).alias("g")
    joined = g.join(o, F.col("g.lang").eqNullSafe(F.col("o.lang")) & F.col("g.source").eqNullSafe(F.col("o.source")), "left") \
        .join(b, F.col("g.lang").eqNullSafe(F.col("b.lang")), "left")
    def drawn(side: str, name: str, toward: Column) -> Column:
        n = F.coalesce(F.col(f"{side}.n_docs"), F.lit(0))
        return F.coalesce(F.floor((n * F.col(f"{side}.{name}") + PRIOR * toward) / (n + PRIOR)), toward)

    pick = [drawn("o", c, drawn("b", c, F.col(f"g.w.{c}"))).alias(c) for c in names]
    return joined.select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), *pick)


def within(prefix: str, lim: str) -> Column:
    """Verdict: no measure lies beyond its fence (no limits: nothing to judge by)."""
    ok = F.lit(True)
    for rule, sql in ratios(prefix).items():
        v = F.expr(sql)
        ok &= F.coalesce(v <= F.col(f"{lim}.{rule}_high"), F.lit(True))
        if RULES[rule][1] == "both":
            ok &= F.coalesce(v >= F.col(f"{lim}.{rule}_low"), F.lit(True))
    return ok


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          source: str = "source") -> DataFrame:
    """Measures, base rule and verdict of every document."""
    d = columns(docs, doc_id=doc_id, text=text, lang=lang, source=source)
    m = d.select("doc_id", "lang", "source", measure_udf()("text").alias("m")).select("doc_id", "lang", "source", "m.*")
    m = written(m, "measures")
    lim = limits(m)
    on, failed, ok = _verdict(lim, "d.")
    return m.alias("d").join(lim.alias("lim"), on, "left").select("d.*", failed.alias("base_failed"), (~failed & ok).alias("kept"))


def _verdict(lim: DataFrame, prefix: str) -> tuple[Column, Column, Column]:
    on = F.col("d.lang").eqNullSafe(F.col("lim.lang")) & F.col("d.source").eqNullSafe(F.col("lim.source"))
    return on, base_failed(F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")), within(prefix, "lim")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged.  The text
    stays in its partition; only its measures and the limits move."""
    measured = docs.select("lang", "source", measure_udf()("text").alias("m")).select("lang", "source", "m.*")
    lim = limits(written(measured, "measures"))
    d = docs.withColumn("_m", measure_udf()("text")).alias("d")
    on, failed, ok = _verdict(lim, "d._m.")
    return d.join(lim.alias("lim"), on, "left").filter(~failed & ok).select(*[F.col(f"d.`{c}`") for c in docs.columns])
