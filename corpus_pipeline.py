"""The corpus pipeline: quality rules, near-dedup, substring dedup, secret redaction, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents; texts that a stage
changes get their n_chars anew. An empty input gives an empty result, null
texts are handled as each operator says, further columns pass through up to
the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolink.llm import minhash, packing, quality_rules, secrets, substring_dedup
from chronolink.llm.common import checkpointed, table
from chronolink.session import ship


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars as its texts have it, in the order of columns."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    ship(spark)
    return quality_rules.judge(docs, result="_rejected_by").where("_rejected_by is null").drop("_rejected_by")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    ship(spark)
    return minhash.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document holds are cut; other texts stay as they are."""
    ship(spark)
    found = substring_dedup.dedup(docs, with_factors=False)
    return _with_text(found.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))), docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets."""
    ship(spark)
    return _with_text(secrets.redact(docs), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    ship(spark)
    return packing.pack(docs, **packing.LEAN)


STAGES = [
    ("quality_rules", rules_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("secret_scan", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: Near-dedup, redaction by entropy and packing are beyond SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
