"""The queries of this folder, one opN_ for each operator, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hopweave.llm import byte_shards, decontaminate, importance_sampling, license_scan, minhash_dedup, oracles, packing, pii_scan, quality_classifier, quality_rules, repair_files, secrets_scan, substring_dedup, vector_codes
from hopweave.llm.scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op1"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_repair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = repair_files.write_shards(table(spark, sf_dir, "documents"), Scratch(spark, "op3"), tokenizer_file("byte_bpe_50k.json"))
    return repair_files.read_shards(shards)


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text_crc32", F.expr("crc32(cast(coalesce(text, '') AS binary))"))
    placed = byte_shards.assign(docs, Scratch(spark, "op4"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op5"))


def op6_secrets_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.report(secrets_scan.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licenses(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), Scratch(spark, "op8"), tokenizer_file("word_bpe_49k.json"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op10"))
    return decontaminate.report(found)


def op11_pii_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan.report(pii_scan.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"), Scratch(spark, "op12"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_sampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op13"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_quality_rules, op3_repair_files, op4_byte_shards, op5_quality_classifier, op6_secrets_scan, op7_license_scan, op8_best_fit_packing, op9_substring_dedup, op10_decontamination, op11_pii_field, op12_vector_codes, op13_importance_resampling)}
ORACLE_SQL = oracles.ORACLE_SQL
