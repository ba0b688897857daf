"""From raw documents to packed sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvane.llm.common import cut, small_batches
from corvane.llm.jaccard import keep_one
from corvane.llm.language import in_known_languages
from corvane.llm.packing import harmonic_packing
from corvane.llm.secrets import redact
from corvane.llm.suffixes import without_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language, by text, labels of others and source.

    Null and wordless texts have no language and go; null labels and sources are no evidence.  Repeated rows
    and ids each stand for themselves; of equally likely languages the first by name counts.  Extra columns
    stay, whatever their names; long texts are read whole; an empty table stays empty.
    """
    small_batches(spark)
    return in_known_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by word five-grams at a similarity of 0.8 or more.

    The least id stays, null ids last; of one id in a group one row.  Unlike texts under one id all stay, as do null and
    wordless texts.  Extra columns stay, whatever their names; an empty table stays empty.
    """
    small_batches(spark)
    return keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages of 250 bytes (some fifty words) or more that stand elsewhere too out of the texts.

    All rows stay, with null texts null and others perhaps empty; ids may be null or repeated, and a repeated row loses its
    whole text if that is long enough.  Extra columns stay, whatever their names; an empty table stays empty.
    """
    small_batches(spark)
    return without_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark.

    All rows stay; null texts stay null, empty ones empty; overlapping secrets get one mark.  Ids are not read; extra
    columns stay, whatever their names; texts of any length are read whole.
    """
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts' tokens into sequences: one row per piece of a document.

    Null and empty texts are their end token alone; ids may be null or repeated, and each row is a document; other
    columns are not read; an empty table gives no pieces.
    """
    small_batches(spark)
    return harmonic_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("secrets", secrets), ("packing", packing)]

#: The near-duplicate, suffix and tokenizer stages have no SQL form; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
