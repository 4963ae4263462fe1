"""The registered corpus queries: thin columns over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontaminate, html_text, hard_negatives, kneser_ney, language_id, merkle, packing, quality, secrets, simhash, simhash_dedup, toxicity, url_lm


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_html_text": op2_html_text,
    "op3_simhash_fingerprints": op3_simhash_fingerprints,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_packing": op5_packing,
    "op6_url_filter": op6_url_filter,
    "op7_toxicity": op7_toxicity,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_language_id": op9_language_id,
    "op10_secret_scan": op10_secret_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_quality_rules": op12_quality_rules,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL: dict[str, str] = {"op11_merkle_manifest": merkle.SQL, "op12_quality_rules": quality.SQL, "op13_hard_negatives": hard_negatives.SQL}
