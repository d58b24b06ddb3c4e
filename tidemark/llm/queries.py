"""The registered queries of the numbered operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, divergence, language_id, mixing, near_dedup, ordinal_quality, packing, quality_rules, recompression, repair, secret_scan, sql, suffix_dedup

#: Target shares of tokens; values that are not listed keep their natural share of the rest.
TARGETS = {
    "source": {"src0": 0.10, "src1": 0.08},
    "lang": {"en": 0.55, "fr": 0.18, "de": 0.15, "es": 0.12},
    "topic": {"table": 0.05, "licence": 0.10, "note": 0.05, "article": 0.45, "report": 0.35},
}
BUDGET = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"), secret_scan.train_forest(spark))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], given.schema)
    formatted = chat_format.format_trees(chat_format.chain_messages(given.unionByName(extra)))
    return chat_format.read_back_digests(formatted)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), TARGETS, BUDGET)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings: 0 toxic, 1 low quality, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = ordinal_quality.train(docs, grades(_table(spark, sf_dir, "labels")), 3)
    return ordinal_quality.grade_documents(docs, model, tail=2)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_strings(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the query's SQL learns of no smaller language and no longer word
    df = quality_rules.quality_verdicts(_table(spark, sf_dir, "documents"), parts=quality_rules.LANGUAGE_PARTS, longest=quality_rules.MAX_COMMON_CHARS)
    return df.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeated_windows(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learned = language_id.learn_dictionaries(docs.where(~language_id.held_out()))
    return language_id.predict_languages(docs, learned)


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = repair.damage(_table(spark, sf_dir, "conversations"))
    return repair.repaired_digests(repair.repair_conversations(damaged, F.col("present")))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_secret_scan, op3_chat_format, op4_source_mixing, op5_decontamination, op6_ordinal_quality, op7_suffix_dedup, op8_quality_rules, op9_recompression, op10_language_id, op11_structure_repair, op12_best_fit_packing, op13_source_divergence)}

#: Compression, forests, regressions, raking and byte strings have no short SQL; tests hold those queries against brute force.
ORACLE_SQL = sql.ORACLE_SQL
