"""The corpus pipeline: five stages, each over all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last
return the columns of ``documents``. Null texts, empty tables and extra columns
are handled as each operator's module says.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veinworks.llm import decontam, neardup, packing, quality, secret_scan
from veinworks.llm.queries import tokenizer_file
from veinworks.llm.storage import checkpoint_dir, checkpointed, deleted, scratch, small_batches, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels that aren't held out."""
    labels = table(spark, sf_dir, "labels")
    model = quality.fitted(checkpointed(quality.with_statistics(quality.training_rows(docs, labels))), labels)
    return quality.accepted(docs, model)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secret_scan.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("decontamination", clean_of_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL can express neither the hashing nor the models; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder as Parquet and read again.

    A stage's intermediate tables, and the result that it read, are deleted when it is written.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch(), small_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            deleted(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
