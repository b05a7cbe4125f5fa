"""Documents to token counts: language ID, exact dedup, n-gram Jaccard join, source mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) with docs in the columns of ``documents`` and is written
as Parquet and read again before the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import bpe, exact_dedup, language_id, mixing, ngram_join, store

#: A text whose best cosine is below this is in no learned language.
LEAST_SCORE = 0.02
#: Nor is one with a cosine below ``RISE`` times the root of its evidence, ``ENOUGH`` at most: cosines of texts in a language grow with
#: that root, those of others stay near 1 / sqrt(1024), and random letters of any length stay under ``ENOUGH``. Clean texts of sf0.01 and
#: short ones of check_s have a ratio of 0.0189 and more, others of 60 trigrams or more one under 0.015.
RISE, ENOUGH = 0.016, 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters, or like no learned language, go; the language found takes the place of ``lang``."""
    found = language_id.identify(docs)
    least = F.greatest(F.lit(LEAST_SCORE), F.least(F.lit(ENOUGH), RISE * F.sqrt("language.evidence")))
    kept = found.where((F.col("language.lang_pred") != language_id.UNKNOWN) & (F.col("language.score") >= least))
    return kept.withColumn("lang", F.col("language.lang_pred")).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest identifier stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by links of n-gram similarity the one with the smallest identifier stays."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeat, or thin out, to shares in proportion to the root of their size."""
    return mixing.poisson_mix(docs, info=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and hashes of every copy."""
    return bpe.encode_column(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


STAGES = [
    ("language ID", identify_language), ("exact dedup", drop_exact_copies), ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources), ("byte-level BPE", encode),
]

#: Language ID and BPE can't be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, _ = store.settle(docs, "stage")
    return docs
