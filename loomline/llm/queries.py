"""The registered queries of the subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path
from . import bwt_dedup, exact_dedup, hard_negatives, language_id, mixing, packing, sharding, simhash, spelling, suffix_trees, token_counts, vptree, wrappers

TOKENIZER = "word_bpe_49k.json"


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vptree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calls on one cache: the first meets misses only and encodes each distinct text, the second reads hits only."""
    docs, cache = table(spark, sf_dir, "documents"), fresh_path(spark, "token-cache")
    token_counts.token_counts(docs, tokenizer(), 2048, cache)
    return token_counts.token_counts(docs, tokenizer(), 2048, cache)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.bwt_dedup(table(spark, sf_dir, "documents"), 400)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), 4096, 1)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"), 4, 4)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All the kinds of evidence: text, declared markup, address suffix, domain and host."""
    model = language_id.fit(table(spark, sf_dir, "documents"))
    return language_id.page_language_id(table(spark, sf_dir, "pages"), model)


def op9_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_trees.substring_dedup(table(spark, sf_dir, "documents"), 20)


def op11_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(vectors, F.col("id") % 50 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_vptree_search, op2_token_counts, op3_exact_dedup, op4_bwt_dedup, op5_best_fit_packing, op6_mix_sources,
        op7_simhash_dedup, op8_language_id, op9_balanced_shards, op10_substring_dedup, op11_wrapper_text, op12_spelling_variants, op13_hard_negatives, language_id_pages, pipeline,
    )
    return {f.__name__: f for f in own}


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY h ORDER BY chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
  count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY h ORDER BY chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kept,
  h AS text_sha256
FROM d
"""

OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS word
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)),
s AS (
  SELECT doc_id, i, word,
    string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS run,
    count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n
  FROM w),
f AS (
  SELECT doc_id, i, word, n = 20 AND row_number() OVER (PARTITION BY n, md5(run) ORDER BY doc_id, i) > 1 AS again FROM s),
g AS (
  SELECT doc_id, i, word,
    bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
r AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""


OP13_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
    list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, other_id, br) AS n FROM s WHERE same),
h AS (
  SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.ar, p.n ORDER BY s.score DESC, s.other_id, s.br)::INTEGER AS rank
  FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
  WHERE p.n <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op10_substring_dedup": OP10_SQL, "op13_hard_negatives": OP13_SQL}
