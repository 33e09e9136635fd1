"""Connected components of a link table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (columns ``a``, ``b``); the
    component is its smallest id.

    Each round, every node hooks onto its smallest neighbour if that is
    smaller, pointer jumping flattens the trees, and the links are rewritten
    between roots.  Every root that is no local minimum vanishes, so the rounds
    are logarithmic in the size of the largest component.
    """
    def between(df):
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()

    edges = written(between(links), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy("a").agg(F.min("b").alias("m"))
                       .select(F.col("a").alias("id"), F.least("a", "m").alias("root")), "hooks")
        while True:
            up = hook.select(F.col("id").alias("up_id"), F.col("root").alias("up_root"))
            nxt = written(hook.join(up, F.col("root") == F.col("up_id"))
                          .select("id", F.col("up_root").alias("root"), (F.col("root") != F.col("up_root")).alias("moved")), "jumps")
            hook = nxt.select("id", "root")
            if nxt.filter("moved").isEmpty():
                break
        if labels is None:
            labels = hook.withColumnRenamed("root", "component")
        else:
            r = hook.select(F.col("id").alias("component"), "root")
            labels = written(labels.join(r, "component", "left")
                             .select("id", F.coalesce("root", "component").alias("component")), "labels")
        ra = hook.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        rb = hook.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        edges = written(between(edges.join(ra, "a").join(rb, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "links")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
