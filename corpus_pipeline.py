"""A pipeline over ``documents``: quality rules, near-duplicates, personal data, a mix of sources, token ids.

Each stage reads the table that the one before it wrote. The first four return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, mixing, pii, quality, simhash
from docloom.llm.runtime import remove, shared_folder, staging


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the adaptive thresholds of their language and source."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 or more."""
    return simhash.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data replaced by the kind; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.materialise(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digests of the ids and of the text that they decode to."""
    return bpe.round_trip(docs, bpe.vocabulary("byte_bpe_50k.json"), keep=("doc_id", "lang", "source"))


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("pii", personal_data), ("mix", mix), ("bpe", token_ids)]

#: SQL has no XXH64 fingerprints, seeded rounding or byte-pair merges; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result but the last is written as Parquet in the shared folder and read again.

    A table is deleted when the next one is written; that of the last but one stage stays, as the result reads it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with staging(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)
