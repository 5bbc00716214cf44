"""The operators' queries for the registry: production parameters, whole tables, contract columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import topk

    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import jaccard

    return jaccard.join(table(spark, sf_dir, "documents")).drop("n_links")  # not a column of the contract


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import toxicity
    from lodestone.llm.common import remainder

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon, weights = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, lexicon, weights)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import pii

    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count_of("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import urls

    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import lm

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op7_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import media

    return media.copies(media.page_media(table(spark, sf_dir, "pages")), "page_id")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import bpe

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import dac

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dac.read(spark, dac.write(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import packing

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_ngram_jaccard, op3_toxicity, op4_personal_data, op5_url_filter, op6_lm_score, op7_media_copies, op8_byte_bpe, op9_token_files, op10_packing)}

#: Linked pairs by shared n-grams, then reachability, as plain SQL.
OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM reach r JOIN links l ON l.x = r.doc_id WHERE l.y > r.c)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, k.c AS copy_of
FROM sets s JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) m USING (doc_id)
JOIN (SELECT doc_id, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s)) END AS c FROM sets) k USING (doc_id)
"""
OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
ORACLE_SQL: dict[str, str] = {"op1_exact_topk": OP1_SQL, "op2_ngram_jaccard": OP2_SQL}
