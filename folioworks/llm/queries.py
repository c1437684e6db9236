"""Queries and SQL of this subpackage, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, fingerprint, importance, jaccard_join, language_id, main_text, periodic_runs, personal_data, quality, sentence_pieces, source_mix, substring_dedup, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard_join": lambda spark, sf_dir: jaccard_join.op1(_documents(spark, sf_dir)),
    "op2_language_id": lambda spark, sf_dir: language_id.op2(_documents(spark, sf_dir)),
    "op3_main_text": lambda spark, sf_dir: main_text.op3(_pages(spark, sf_dir)),
    "op4_source_mix": lambda spark, sf_dir: source_mix.op4(_documents(spark, sf_dir)),
    "op5_personal_data": lambda spark, sf_dir: personal_data.op5(_documents(spark, sf_dir)),
    "op6_byte_bpe": lambda spark, sf_dir: byte_bpe.op6(_documents(spark, sf_dir)),
    "op7_fingerprint": lambda spark, sf_dir: fingerprint.op7(_documents(spark, sf_dir)),
    "op8_quality": lambda spark, sf_dir: quality.op8(_documents(spark, sf_dir)),
    "op9_toxicity": lambda spark, sf_dir: toxicity.op9(_documents(spark, sf_dir), _labels(spark, sf_dir)),
    "op10_substring_dedup": lambda spark, sf_dir: substring_dedup.op10(_documents(spark, sf_dir)),
    "op11_sentence_pieces": lambda spark, sf_dir: sentence_pieces.op11(_documents(spark, sf_dir)),
    "op12_importance": lambda spark, sf_dir: importance.op12(_documents(spark, sf_dir), _benchmark(spark, sf_dir)),
    "op13_periodic_runs": lambda spark, sf_dir: periodic_runs.op13(_documents(spark, sf_dir)),
}

# The other operators learn, iterate, hash or parse; tests compare them with brute force instead.
ORACLE_SQL: dict[str, str] = {"op12_importance": importance.SQL}
