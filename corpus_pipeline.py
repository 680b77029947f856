"""Corpus pipeline: documents pass the stages in order, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm import bpe, decontaminate, near, pii, toxicity
from marketspark.llm.common import table
from marketspark.operators.lineage import shared_folder


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more; the model learns from all labels whose document is here."""
    scored = toxicity.scored(docs, table(spark, sf_dir, "labels"))
    return scored.where("score < 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group; near are five-word shingles of similarity 0.8 or more, found by
    SimHash fingerprints of 512 bits in an index over byte positions."""
    return near.representatives(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    marked = decontaminate.marked(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(F.size("leaks") == 0).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text."""
    return pii.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_tokens, decoded."""
    return bpe.encoded(docs, bpe.vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("simhash", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("pii", personal_data),
    ("bpe", tokens),
]

#: Classifier, fingerprints and BPE are beyond SQL; tests compare with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is kept in the shared folder of spark.checkpoint.dir."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
