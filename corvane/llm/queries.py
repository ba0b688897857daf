"""The numbered operators' queries over their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvane.llm.bpe import bpe_digests
from corvane.llm.common import small_batches
from corvane.llm.divergence import DIVERGENCE_SQL, source_divergence
from corvane.llm.jaccard import JACCARD_SQL, jaccard_components
from corvane.llm.language import language_id
from corvane.llm.merkle import MERKLE_SQL, merkle_manifest
from corvane.llm.packing import harmonic_packing
from corvane.llm.secrets import SECRETS_SQL, secret_scan
from corvane.llm.substrings import SUBSTRING_SQL, substring_dedup
from corvane.llm.suffixes import suffix_dedup
from corvane.llm.toxicity import toxicity
from corvane.llm.url_filter import URL_SQL, judge_urls
from corvane.llm.vectors import nearest_neighbours, top_products
from corvane.sources.readers import spread


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    rows = small_batches(spark).read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(rows) if table == "documents" else rows


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_packing(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(read(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(read(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


QUERIES = {"op1_language": op1_language, "op2_secrets": op2_secrets, "op3_toxicity": op3_toxicity, "op4_ann": op4_ann, "op5_urls": op5_urls, "op6_packing": op6_packing, "op7_jaccard": op7_jaccard, "op8_suffixes": op8_suffixes, "op9_topk": op9_topk, "op10_bpe": op10_bpe, "op11_substrings": op11_substrings, "op12_merkle": op12_merkle, "op13_divergence": op13_divergence}

TOPK_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
 FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

ORACLES: dict[str, str] = {"op7_jaccard": JACCARD_SQL, "op5_urls": URL_SQL, "op9_topk": TOPK_SQL, "op2_secrets": SECRETS_SQL, "op11_substrings": SUBSTRING_SQL, "op12_merkle": MERKLE_SQL, "op13_divergence": DIVERGENCE_SQL}
