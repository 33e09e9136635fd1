"""Near-duplicate documents by banded MinHash and odd sketches.

Defined results: a document without words has an empty set and is linked with
nothing; fewer words than the shingle width make one shingle; of rows that
share a doc_id each is judged by its own text, and what is linked to either is
linked through the id; rows without doc_id are linked with nothing and have a
null component; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, columns, tidy, written
from .minhash import SETS, SKETCH, Scheme, SetMaker, classes_of, set_columns, similar_components, sketch_columns

# 40 bands of 6 samples find a pair of similarity 0.8 but for 5 in a million.
DOCUMENTS = Scheme(words=4, percent=80, bands=40, rows=6, samples=240, bits=1024)


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split() if text else []


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scheme: Scheme = DOCUMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    d = columns(docs, id=doc_id, text=text).withColumn("id", F.col("id").cast("long"))

    def sketch(it):
        make = SetMaker(scheme.words)
        for batch, texts in batches(it):
            cols = {"id": batch.column("id")} | sketch_columns(make([words_of(t) for t in texts]), scheme)
            yield pa.record_batch(list(cols.values()), list(cols))

    def full_sets(it):
        make = SetMaker(scheme.words)
        for batch, texts in batches(it):
            sets = make([words_of(t) for t in texts])
            full = [i for i, s in enumerate(sets) if len(s)]
            cols = {"id": batch.column("id").take(pa.array(full, pa.int64()))} | set_columns([sets[i] for i in full], scheme)
            yield pa.record_batch(list(cols.values()), list(cols))

    rows = written(d.mapInArrow(tidy(sketch), "id bigint, " + SKETCH), "sketches")
    # a null id never joins, so such rows neither link nor represent a class
    classes = written(classes_of(rows.filter("id is not null")), "classes")
    found = similar_components(
        classes, lambda ids: d.join(ids, "id", "left_semi").mapInArrow(tidy(full_sets), "id bigint, " + SETS), scheme)
    # Only classes with copies or links need a lookup; all other rows stand alone.
    known = classes.join(found.withColumnRenamed("id", "found"), F.col("id") == F.col("found"), "left") \
        .filter("n > 1 or component is not null") \
        .select("d1", "d2", F.coalesce("component", "id").alias("component_id"))
    out = rows.select("id", "n_shingles", "d1", "d2").join(known, ["d1", "d2"], "left") \
        .select(F.col("id").alias("doc_id"), "n_shingles",
                F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, scheme: Scheme = DOCUMENTS) -> DataFrame:
    """``docs`` with one document of each group: the smallest doc_id."""
    gone = near_duplicates(docs, scheme=scheme).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
