"""The registered queries opN_<name> of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, langid, licenses, mixing, quality, secrets, simhash, suffixes, urls
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.score_urls(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op7_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of each document's text as a clip; the tables hold no audio."""
    return audio.audio_features(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_quality(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_simhash_dedup, op3_bpe_encode, op4_url_filter, op5_secret_scan, op6_suffix_dedup, op7_audio_features, op8_license_scan, op9_quality_rules, op10_language_id)
}
ORACLES: dict[str, str] = {"op1_mix_sources": mixing.ORACLE, "op4_url_filter": urls.ORACLE, "op9_quality_rules": quality.ORACLE}
