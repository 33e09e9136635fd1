"""Removal of near-equal paragraphs by MinHash banding.

A text is cut into paragraphs at line ends and, because passages are also
copied into the middle of lines, before and after every sentence of at least
``LONG_SENTENCE`` words; shorter sentences between two cuts are one paragraph.
So a copied long sentence or line is cut alike wherever it stands, and a copied
short sentence where its neighbours are alike.  Paragraphs with equal
words form classes.  Classes that share none of their few smallest shingle
hashes with another, as every pair that reaches the threshold does, are set
aside before anything is banded: this exact filter loses no link and leaves few
classes.  Those get MinHash bands tuned for recall (all but one in 100,000 pairs
at the threshold); what collides is verified by exact Jaccard similarity, and
of every connected component the first paragraph (smallest doc_id, then place)
stays.

Defined results: every paragraph with a word is judged, and fewer words than
the shingle width are one shingle; null, empty and blank texts have none; rows without doc_id take no part; of
rows that share a doc_id, equal places count as one place; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, as_long, batches, columns, marked, text_slices, tidy, written
from .minhash import SETS, SKETCH, Banded, Prefixes, SetMaker, classes_of, sequence_columns, set_columns, sharing, similar_components
from .near import words_of

LONG_SENTENCE = 8
# 22 bands of 4 samples find a pair of similarity 0.8 but for one in 100,000.
PARAGRAPHS = Banded(words=5, percent=80, bits=256, bands=22, rows=4)

STOP = re.compile(rb"\n|[.!?]+(?=[ \t\r\n\x0b\x0c]|\Z)")


def cut(text: bytes | None, long_sentence: int = LONG_SENTENCE) -> list[tuple[int, int, int, list[bytes]]]:
    """(number, start, end, words) of the paragraphs, each of a word at least."""
    if not text:
        return []
    out, start, seen = [], 0, []
    at = 0

    def close(end):
        nonlocal start, seen
        if seen:
            out.append((len(out), start, end, seen))
        start, seen = end, []

    for m in STOP.finditer(text):
        sentence = words_of(text[at:m.end()])
        long = len(sentence) >= long_sentence
        if long:
            close(at)                          # short sentences before a long one
        seen = seen + sentence if seen else sentence
        at = m.end()
        if long or m.group()[:1] == b"\n":
            close(at)
    sentence = words_of(text[at:])
    if len(sentence) >= long_sentence:
        close(at)
    seen = seen + sentence
    close(len(text))
    return out


PLACE = "id bigint, doc_id bigint, number int, start int, finish int, n_words int, "


def repeated_paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scheme: Banded | Prefixes = PARAGRAPHS) -> DataFrame:
    """One row per paragraph to remove: doc_id, paragraph, start and n_bytes in
    the text, n_words, and the paragraph that stays (kept_doc_id, kept_paragraph).
    With ``Prefixes`` in place of bands the join misses no pair at all."""
    first_keys = Prefixes(scheme.words, scheme.percent, scheme.bits)
    d = columns(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")).filter("doc_id is not null")

    def sketch(it):
        hasher, made = WordHasher(), 0
        base = TaskContext.get().partitionId() << 36
        for batch, texts in batches(it):
            rows = [(doc, p) for doc, t in zip(batch.column("doc_id").to_pylist(), texts) for p in cut(t)]
            if not rows:
                continue
            ints = [pa.array([p[k] for _, p in rows], pa.int32()) for k in range(3)]
            cols = {"id": pa.array(np.arange(made, made + len(rows)) + base), "doc_id": pa.array([doc for doc, _ in rows], pa.int64()),
                    "number": ints[0], "start": ints[1], "finish": ints[2],
                    "n_words": pa.array([len(p[3]) for _, p in rows], pa.int32())} | sequence_columns([p[3] for _, p in rows], hasher, first_keys)
            made += len(rows)
            yield pa.record_batch(list(cols.values()), list(cols))

    def full_sets(it):
        make = SetMaker(scheme.words)
        for batch in it:
            for a, texts in text_slices(batch.column("text")):
                places = batch.column("places").slice(a, len(texts)).to_pylist()
                rows = [(p["id"], words_of(t[p["start"]:p["finish"]])) for t, ps in zip(texts, places) if t for p in ps]
                rows = [r for r in rows if r[1]]
                if not rows:
                    continue
                sets = make([r[1] for r in rows])
                keys, n_keys = scheme.keys(np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])]))
                cols = {"id": pa.array([r[0] for r in rows], pa.int64())} | set_columns(sets, scheme)
                cols["bands"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n_keys], dtype=np.int32)), pa.array(as_long(keys)))
                yield pa.record_batch(list(cols.values()), list(cols))

    units = written(d.mapInArrow(tidy(sketch), PLACE + SKETCH), "paragraphs")
    classes = written(classes_of(units), "classes")
    suspects = written(sharing(classes), "suspects")
    wanted = units.filter(marked(suspects, "id")("id")).select("id", "doc_id", "start", "finish").join(suspects, "id").groupBy("doc_id") \
        .agg(F.collect_list(F.struct("id", "start", "finish")).alias("places"))
    sets = d.join(wanted, "doc_id").select("text", "places").mapInArrow(tidy(full_sets), f"id bigint, {SETS}, bands array<bigint>")
    sets = written(sets, "sets")

    found = similar_components(sets.select("id", "bands"), sets.select("id", "m", "s", "odd"), scheme)
    found = written(found.withColumnRenamed("id", "found"), "found")
    alike = classes.select("d1", "d2", "id", "n").join(found, F.col("id") == F.col("found"), "left") \
        .filter("n > 1 or component is not null").select("d1", "d2", F.coalesce("component", "id").alias("component"))
    alike = written(alike, "alike")
    places = units.select("doc_id", "number", "start", "finish", "n_words", "d1", "d2")
    members = written(places.filter(marked(alike, "d1")("d1")).join(alike, ["d1", "d2"]).drop("d1", "d2"), "members")
    first = members.groupBy("component").agg(F.min(F.struct("doc_id", "number")).alias("kept"))
    return members.join(first, "component") \
        .filter((F.col("doc_id") != F.col("kept.doc_id")) | (F.col("number") != F.col("kept.number"))) \
        .select("doc_id", F.col("number").alias("paragraph"), "start", (F.col("finish") - F.col("start")).alias("n_bytes"), "n_words",
                F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.number").alias("kept_paragraph"))
