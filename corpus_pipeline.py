"""The corpus pipeline: quality filter, near-dedup, decontamination, mixing and token output over `documents`.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet and read
again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm import decontaminate, mixing, quality, simhash, token_output
from fieldspark.llm.common import documents, materialize


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates ask for."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simple8b_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The written token files, read back: one row a document."""
    return token_output.token_output(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing_to_target_weights", mixing_to_targets),
    ("token_binary_output", simple8b_output),
]

#: Classifier scores, fingerprints, fitted rates and tokenizers are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
