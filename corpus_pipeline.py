"""Pipeline over the documents: every stage works on all its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns documents of the same columns; the
last returns the mix, a row for each repetition, numbered in ``repetition``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bidframe.llm import decontaminate, jaccard_join, mixing, pii, toxicity
from bidframe.llm.common import cut, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents graded toxic go; the model learns from the labels of this stage's documents."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id: shingles of 5 words, similarity 0.8."""
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; all documents stay."""
    return pii.redact(docs, pii.train(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to target weights, at most three times each."""
    return mixing.repeat(docs, mixing.cycle_weights(docs))


STAGES = [("toxicity", reject_toxic), ("near_duplicates", near_duplicates), ("decontamination", decontaminated),
          ("pii", redacted), ("mixing", mixed)]

#: No SQL can express the trained stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut(docs)
    return docs
