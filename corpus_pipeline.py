"""Corpus pipeline: language ID, near-duplicate removal, substring deduplication, packing.

Every stage takes any table with the columns of documents: nulls in any column, empty and very long texts, ties and repeated rows,
empty tables, and extra columns, which pass through all but the last stage. The operators' modules state each case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltworks.llm import language_id, packing, simhash, span_dedup
from siltworks.llm.common import stored


#: Texts go to the Python workers in Arrow batches of at most so many rows and bytes, to bound what a batch takes on both sides.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def _bounded(spark: SparkSession) -> None:
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified. Null texts, and texts without letters, go."""
    _bounded(spark)
    return language_id.keep_identified(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. Of rows with one doc_id and text one stays."""
    _bounded(spark)
    return simhash.deduplicate(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of sentences, and ``n_chars`` accordingly. Documents that are emptied go."""
    _bounded(spark)
    return span_dedup.remove_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, bin, at) of every piece of every text. Empty texts have none."""
    _bounded(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("language_id", language_stage), ("simhash", simhash_stage), ("substring_dedup", substring_stage), ("best_fit_packing", packing_stage)]

#: SQL can't express the trained classifier, the fingerprints or the packing; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of ``documents``; each stage's output is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
