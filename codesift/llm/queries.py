"""Driver queries: one per operator, over the whole of its table."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dialogue, hilbert, near, packing, paragraphs, periodic, pivots, positional, quality, repeats, warc, wavelet
from .common import table

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    ranked = hilbert.hilbert_order(docs, hilbert.document_dims(docs), [F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    return hilbert.cut_runs(ranked, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("_curve").alias("curve_index"))


def op2_longest_previous_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op3_odd_sketch_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op6_paragraph_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.rotate(table(spark, sf_dir, "conversations"))


def op8_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = positional.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"))


def op10_rank_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def with_repeats(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Input of op11: documents whose id has a crc32 divisible by ten repeat a
    stretch of their words up to their end."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op11_kruskal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.summary(periodic.periodic_runs(table(spark, sf_dir, "documents"), rewrite=with_repeats))


def op12_ptolemaic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pivots.cluster(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", pivots.centroid_digest("centroid").alias("centroid_sha256"))


def op13_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER))


def _clusters_sql() -> str:
    """Three rounds from the vectors of the 16 smallest digests, then one more
    assignment, all in integers."""
    parts = ["""vectors AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
             """c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM vectors
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= 16)"""]
    for r in range(4):
        parts.append(f"""a{r} AS (SELECT vec_id, p.v AS v, min(struct_pack(d := list_sum(list_transform(list_zip(p.v, c{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT,
    c := c)) AS best FROM (SELECT *, row_number() OVER () AS n FROM vectors) p, c{r} GROUP BY n, vec_id, p.v)""")
        if r < 3:
            # exact floor of a quotient: what is left over is taken off first
            parts.append(f"""s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i),
m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r + 1} AS (SELECT c{r}.c AS c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))""")
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c3.v, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON best.c = c3.c"""


QUERIES = {f.__name__: f for f in (op1_hilbert_sharding, op2_longest_previous_factor, op3_odd_sketch_near_dups, op4_warc_chain, op5_adaptive_quality,
                                   op6_paragraph_banding, op7_perspective_rotation, op8_kk_packing,
                                   op9_positional_decontamination, op10_rank_merge_counts, op11_kruskal_runs,
                                   op12_ptolemaic_clusters, op13_wavelet_shards)}
ORACLES: dict = {"op12_ptolemaic_clusters": _clusters_sql}
