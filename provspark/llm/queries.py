"""The queries of the training-data operators, each over its whole table, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from provspark.llm import brown_lm, licenses, media, mixing, packing, pii, quality, simhash, token_counts, warc
from provspark.llm.common import documents


def op1_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(documents(spark, sf_dir))


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op7_mix_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op6_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")), key="page_id")


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.scores(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality.sql(), "op6_license_digests": licenses.sql()}
