"""The queries of the training-data operators, over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from limn.llm import licenses, media, mixing, packing, quality, simhash, token_counts, topk, toxicity, warc
from limn.llm.common import written


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), words=3, distance=3)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.payloads(_read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")), 0.7)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.quality(docs, quality.train(docs, _read(spark, sf_dir, "labels")), 0.5)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_read(spark, sf_dir, "documents")).withColumn("position", F.round("position", 9))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op9_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns of license_spans; score: 1 with an exact phrase, else 1 less the share of edits of the best span."""
    found = licenses.license_spans(_read(spark, sf_dir, "documents"))
    base, spans = F.col("base"), F.col("spans")
    labels = lambda *arrays: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(a, lambda x: x["label"]) for a in arrays)))), ",")
    near = F.transform(spans, lambda s: F.greatest(1 - s["edits"] / (5.0 * s["words"]), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["word"])).alias("first_word"), F.array_max(F.transform(base, lambda x: x["word"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(base, spans).alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(F.array_max(near), F.lit(0.0))).alias("score"),
        F.transform(spans, lambda s: F.concat_ws(":", s["label"], s["word"].cast("string"), s["words"].cast("string"), s["edits"].cast("string"))).alias("spans"),
    )


QUERIES = {f.__name__: f for f in (op1_simhash_near_duplicates, op2_media_columns, op3_token_counts, op4_best_fit_packing, op5_toxicity, op6_quality, op7_source_mixing, op8_exact_top_k, op9_warc_reassembly, op10_license_scan)}

ORACLE_SQL = {
    "op7_source_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
        w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) AS class, 3 * n AS lim FROM s),
        f AS (SELECT *, class + 1 AS weight, lim / CAST(class + 1 AS DOUBLE) AS ratio FROM w),
        a AS (SELECT CAST(sum(n) AS BIGINT) AS words, CAST(sum(weight) AS BIGINT) AS weights FROM f),
        b AS (SELECT *, coalesce(sum(lim) OVER o, 0) AS lims, coalesce(sum(weight) OVER o, 0) AS ws FROM f WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        m AS (SELECT b.*, (a.words - lims) * weight > lim * (a.weights - ws) AS stopped FROM b, a),
        l AS (SELECT (a.words - g.n) / CAST(a.weights - g.w AS DOUBLE) AS level FROM a, (SELECT coalesce(sum(lim) FILTER (stopped), 0) AS n, coalesce(sum(weight) FILTER (stopped), 0) AS w FROM m) g),
        t AS (SELECT source, n, class, CASE WHEN stopped THEN CAST(lim AS DOUBLE) ELSE least(weight * level, CAST(lim AS DOUBLE)) END AS target FROM m, l),
        p AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
        j AS (SELECT doc_id, size, n, class, target, start, CAST(round(target) AS BIGINT) AS budget FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
        k AS (SELECT *, CASE WHEN n > 0 THEN budget // n ELSE 0 END AS passes FROM j),
        x AS (SELECT *, CAST(passes * size + least(greatest(budget - passes * n - start, 0), size) AS BIGINT) AS taken, CAST(start AS DOUBLE) / CAST(budget AS DOUBLE) AS y FROM k)
        SELECT doc_id, size, n AS source_size, target, taken, CASE WHEN taken = 0 THEN NULL ELSE round(CASE class
            WHEN 0 THEN 2 * y / (1.5 + sqrt(greatest(2.25 - 2 * y, 0)))
            WHEN 1 THEN y
            ELSE CASE WHEN y <= 0.375 THEN 2 * y / (0.5 + sqrt(0.25 + 2 * y)) ELSE 0.5 + 2 * (y - 0.375) / (1 + sqrt(1 + 2 * (y - 0.375))) END END, 9) END AS position
        FROM x""",
    "op8_exact_top_k": """
        WITH u AS (SELECT DISTINCT vec_id, embedding FROM embeddings),
        v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM u
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_warc_reassembly": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
        t AS (SELECT payload_digest, payload_bytes, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY ALL)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN top IS NULL OR top IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN top IS NOT DISTINCT FROM page_id THEN NULL ELSE top END AS refers_to
        FROM d LEFT JOIN t USING (payload_digest, payload_bytes)""",
}
