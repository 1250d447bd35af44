"""From raw documents to packed windows: quality rules, near-dedup, decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and but for the last returns the columns of docs. `run` writes every
stage's result as Parquet in the shared folder and reads it again for the next stage, so a lost executor costs one stage's tasks at most. A stage's files go when the
next stage's are written; the last stage's stay, as the result reads them.

Defined cases, for all stages: nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns are treated as the
operators' modules say. A row with a null text passes the filtering stages and is not packed. A row with a null doc_id is judged by its text alone: it goes if
it repeats itself or holds an item of the benchmark, and it's nobody's copy.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quernal.llm import op02_minhash, op03_decontam, op04_secrets, op08_quality, op09_packing
from quernal.session import remove, shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that repeat themselves too much."""
    return op08_quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies."""
    return op02_minhash.drop_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold an item of the benchmark."""
    return op03_decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by marks."""
    return op04_secrets.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each text goes in windows of fixed length."""
    return op09_packing.windows(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Secret checksums, latent retrieval and least squares are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
