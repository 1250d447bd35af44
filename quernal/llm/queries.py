"""Queries of this subpackage by name, each over whole tables with production parameters, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernal.llm import op01_chat, op02_minhash, op03_decontam, op04_secrets, op05_sharding, op06_urls, op07_warc, op08_quality, op09_packing, op10_suffix
from quernal.session import table


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return op02_minhash.groups(table(spark, folder, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return op03_decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return op08_quality.measure(table(spark, folder, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return op10_suffix.repeats(table(spark, folder, "documents"))


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return op04_secrets.findings(table(spark, folder, "documents"))


def op5_extendible_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return op05_sharding.place(table(spark, folder, "documents"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return op09_packing.windows(table(spark, folder, "documents"))


def op7_warc_reassembly(spark: SparkSession, folder: str) -> DataFrame:
    return op07_warc.round_trip(table(spark, folder, "pages"))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return op06_urls.score_urls(table(spark, folder, "pages"))


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return op01_chat.flatten(op01_chat.typed(table(spark, folder, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_minhash_near_dedup, op3_benchmark_decontamination, op4_secret_scan, op5_extendible_sharding, op6_url_filter, op7_warc_reassembly, op8_quality_rules, op9_packing, op10_suffix_array_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": op01_chat.oracle(), "op7_warc_reassembly": op07_warc.oracle(), "op5_extendible_sharding": op05_sharding.oracle(), "op8_quality_rules": op08_quality.oracle()}
