"""Queries of the training-corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, bpe, language_id, license_scan, packing, sharding, simhash, span_dedup, url_filter, vector_dedup


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(_read(spark, sf_dir, "documents")).select("doc_id", "lang", "posterior", "accepted")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify_pages(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "documents"))
    return found.select("page_id", "lang", "posterior", "accepted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.decide(_read(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.detect(_read(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.duplicates(_read(spark, sf_dir, "embeddings"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.removals(_read(spark, sf_dir, "documents"))


def op8_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.extract(audio.render(_read(spark, sf_dir, "embeddings")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_read(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_read(spark, sf_dir, "documents"))


def byte_bpe_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.decode(bpe.encode(_read(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_simhash, op3_url_filter, op4_license_scan, op5_embedding_dedup, op6_best_fit_packing, op7_substring_dedup, op8_audio_features, op9_sharding, op10_byte_bpe, language_id_pages, byte_bpe_decoding)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": url_filter.oracle(), "op9_sharding": sharding.oracle(), "byte_bpe_decoding": "SELECT doc_id, text FROM documents"}
