"""Queries over the sample tables: one per operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wirepulse.llm import (
    chat_format,
    decontamination,
    filter_audit,
    license_scan,
    lm_scoring,
    mixing,
    near_dedup,
    pii,
    quality_classifier,
    quality_rules,
    secret_scan,
    token_files,
    word_runs,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_measures(_table(spark, sf_dir, "documents"))


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents"))


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontamination_report(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(_table(spark, sf_dir, "documents"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(_table(spark, sf_dir, "documents"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf_dir, "documents"))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(_table(spark, sf_dir, "documents"))


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(_table(spark, sf_dir, "documents"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    trees = quality_classifier.fit_quality(docs, _table(spark, sf_dir, "labels"))
    return quality_classifier.quality_scores(docs, trees)


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.run_report(word_runs.with_planted_runs(_table(spark, sf_dir, "documents")))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_report(chat_format.with_hostile_chat(_table(spark, sf_dir, "conversations")))


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_pii": personal_data,
    "op2_mix_sources": mix,
    "op3_secrets": secrets,
    "op4_token_files": tokens,
    "op5_licenses": licenses,
    "op6_near_dedup": near,
    "op7_decontaminate": decontaminate,
    "op8_quality_rules": quality,
    "op9_lm_scoring": language_model,
    "op10_quality_classifier": classified,
    "op11_word_runs": periodic_runs,
    "op12_chat_format": chats,
    "op13_filter_audit": filters,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": mixing.ORACLE_SQL,
    "op11_word_runs": word_runs.ORACLE_SQL,
    "op12_chat_format": chat_format.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
