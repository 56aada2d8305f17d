"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, delta_lloyd, hard_negatives, language_id, licences, neural_lm, packing, passages, quality, simhash, token_counts, topk, warc
from .common import table


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_codec(table(spark, sf_dir, "documents"), "byte_bpe_multi_50k.tiktoken", keep_ids=False)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("distance2")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    net = language_id.train(docs.where(~held_out), "text", "lang", F.col("doc_id"))
    return language_id.predict_language(docs.select("doc_id", held_out.alias("held_out"), "text"), net).drop("text")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", limit=512)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


_OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))


_OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest FROM p),
w AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM w
"""


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd.clusters(table(spark, sf_dir, "embeddings"), k=40, rounds=5)


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds over all vectors and all centroids, one after another."""
    nearest = """a{n} AS (SELECT nr, any_value(v) AS v, first(j ORDER BY d, j) AS j, min(d) AS d FROM (
    SELECT nr, v, j, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM x, c{n}) GROUP BY nr)"""
    mean = """c{m} AS (SELECT c{n}.j, coalesce(s.c, c{n}.c) AS c FROM c{n} LEFT JOIN (
    SELECT j, list((total - ((total % size) + size) % size) // size ORDER BY i) AS c FROM (
        SELECT j, i, CAST(sum(v[i]) AS BIGINT) AS total, count(*) AS size FROM a{n}, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY j, i) GROUP BY j) s ON s.j = c{n}.j)"""
    steps = [s.format(n=n, m=n + 1) for n in range(rounds) for s in (nearest, mean)] + [nearest.format(n=rounds)]
    return f"""
WITH x AS (SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT n - 1 AS j, v AS c FROM (SELECT *, row_number() OVER (ORDER BY sha256('2:' || vec_id), v) AS n FROM x) WHERE n <= {k}),
{", ".join(steps)}
SELECT x.vec_id, CAST(a.j AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN x USING (nr) JOIN c{rounds} c ON c.j = a.j
"""


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return neural_lm.score_texts(table(spark, sf_dir, "documents"), held_out)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


_OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
             CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a, v c WHERE a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE alike),
w AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS n
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
      WHERE p.n <= 5)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM w WHERE n <= 3
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_language_id": op5_language_id,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_exact_topk": op9_exact_topk,
    "op10_warc": op10_warc,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_lm_scores": op12_lm_scores,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {"op2_license_scan": licences.oracle_sql(), "op3_quality_rules": quality.oracle_sql(), "op9_exact_topk": _OP9_SQL, "op10_warc": _OP10_SQL, "op11_centroid_clusters": _op11_sql(), "op13_hard_negatives": _OP13_SQL}
