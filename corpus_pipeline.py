"""Training-data pipeline over `documents`: filter, dedup, decontaminate, redact, mix."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark import ship
from tidemark.llm import decontaminate, mixing, near_dedup, quality_rules, secret_scan
from tidemark.llm._spark import shared_dir
from tidemark.llm.queries import BUDGET, TARGETS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null, empty and short texts fail the base rules; a text of any length is judged whole;
    repeated rows are judged alike, rows that share an id stay together if one passes.
    """
    return quality_rules.drop_low_quality(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays: the one of the smallest id.

    Texts without words are alike to nothing and stay, as do rows with a null id; of rows
    that share an id one stays.
    """
    ship(spark)
    return near_dedup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, with the rows that share their id; null texts stay."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark and n_chars follows; every row stays, repeated ones are scanned each."""
    return secret_scan.redact_secrets(docs, secret_scan.train_forest(ship(spark)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens fit the target shares of source, language and topic.

    Rows without tokens go; a row of a scarce cell is there as often as it has copies; null
    sources and languages are values of their own.
    """
    return mixing.sample_mixture(docs, TARGETS, BUDGET)


STAGES = [
    ("quality rules", quality),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("secret scan", secrets),
    ("mixing", mixture),
]

#: Connected components, compressed search tables and a forest have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    root = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{root}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
