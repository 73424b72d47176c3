"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import common
from quarry.llm import (
    decontamination,
    embedding_dedup,
    language_id,
    license_scan,
    lm_scoring,
    merkle_manifest,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    spelling_variants,
    token_counts,
)
from quarry.llm.oracle import SQL  # noqa: F401 - read by the entry module


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; ``QUARRY_TOKENIZERS`` overrides the folder."""
    folder = os.environ.get("QUARRY_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per finding."""
    found = license_scan.licenses(common.documents(spark, sf_dir))
    return found.selectExpr("doc_id", "inline(findings)")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(common.documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secrets(common.documents(spark, sf_dir)))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated (document, benchmark item)."""
    return decontamination.contaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.fit_and_score(common.documents(spark, sf_dir), in_place=True)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(common.documents(spark, sf_dir), ngram_join.Rule(3, 90, 100))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; trusted are the documents that
    ``labels`` gives quality 1."""
    return quality_rules.quality_rules(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof digest of every document, and whether its
    (perhaps tampered) text still proves the root."""
    return merkle_manifest.checked(common.documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per word of the corpus with its form and the root of its group."""
    return spelling_variants.spelling_variants(common.documents(spark, sf_dir))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_license_scan": op3_license_scan,
    "op4_language_id": op4_language_id,
    "op5_secret_scan": op5_secret_scan,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_packing": op9_packing,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_quality_rules": op11_quality_rules,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_spelling_variants": op13_spelling_variants,
}
