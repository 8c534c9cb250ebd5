"""A training corpus from ``documents``: each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricelake.llm import decontaminate, exact_dedup, near_dedup, quality, queries
from pricelake.runtime import written

#: Kept rows up to this number are sent to all tasks as ids rather than shuffling the texts.
BROADCAST_IDS = 4_000_000


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not among the few ``dropped`` (written) ones; rows without an id stay."""
    ids = written(dropped.select("doc_id").where("doc_id IS NOT NULL").distinct(), "dropped")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier (9) takes for label 0."""
    found = quality.classify(docs, queries.table(spark, sf_dir, "labels"))
    return _without(docs, found.where("predicted = 0"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document (4), the one with the largest id, of each group of equal texts."""
    return _without(docs, exact_dedup.exact_duplicates(docs).where("NOT kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document (1), the one with the least id, of each group linked by five-word shingles at 0.8."""
    return _without(docs, near_dedup.near_duplicates(docs).where("NOT kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage (6)."""
    return _without(docs, decontaminate.leaks(docs, queries.table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left in sequences of 1024 tokens (5)."""
    return queries.packed(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier, the near-duplicate sketch and the tokenizer are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of a folder."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
