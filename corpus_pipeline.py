"""The corpus pipeline over `documents`, from quality rules to encoded tokens."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.bpe import encode_documents
from palimpsest.llm.common import shared_folder, table, until_exit
from palimpsest.llm.mixing import mix_documents
from palimpsest.llm.quality import apply_quality
from palimpsest.llm.secrets import redact_secrets
from palimpsest.llm.simhash import drop_near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that too many documents of a host share; depleted documents go."""
    return apply_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_duplicates(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; all documents stay."""
    return redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the schedule, each as often as it is scheduled, once at least."""
    return mix_documents(docs, without_id=True)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every row, with a check that they decode to its text."""
    return encode_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources", mix_sources),
    ("bpe encoding", bpe_encoding),
]

#: The SimHash, entropy and BPE stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on `documents`, each result written as Parquet to the shared folder and read again; the folder goes when the driver ends."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    until_exit(spark, folder)
    return docs
