"""Queries opN_<name> over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, importance, language_id, minhash, packing, quality_rules, secrets, substring_dedup, toxicity
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(table(spark, sf_dir, "embeddings"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_bpe": op6_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_importance_resampling": op8_importance_resampling,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
}
ORACLE: dict[str, str] = {
    "op2_substring_dedup": substring_dedup.ORACLE_SQL,
    "op5_embedding_near_dedup": embedding_dedup.ORACLE_SQL,
    "op9_quality_rules": quality_rules.ORACLE_SQL,
}
