"""Registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, embeddings, exact_dedup, filter_audit, language, licences, mixing, privacy, quality, sharding, simhash, token_files, vector_codes


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_docs(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rated(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.personal_data(_docs(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_places(_docs(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(_docs(spark, sf_dir))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_docs(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(_docs(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(_docs(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(_docs(spark, sf_dir))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(spark, f"{sf_dir}/documents.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_mixing,
        op2_quality_classifier,
        op3_personal_data,
        op4_token_files,
        op5_license_scan,
        op6_simhash_near_dedup,
        op7_byte_bpe,
        op8_language_id,
        op9_exact_dedup,
        op10_embedding_near_dedup,
        op11_vector_codes,
        op12_filter_audit,
        op13_sharding,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.SQL, "op9_exact_dedup": exact_dedup.SQL, "op10_embedding_near_dedup": embeddings.SQL, "op11_vector_codes": vector_codes.SQL, "op12_filter_audit": filter_audit.SQL}
