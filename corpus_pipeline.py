"""Cleaning a corpus: quality, near-duplicates, benchmark passages, personal
data, mixing. Each stage works on all rows its predecessor kept, written as
Parquet in the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from civicframe.llm import decontaminate, mixing, pii, quality, simhash
from civicframe.llm.common import land, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash group."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def masked_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture of sources."""
    return mixing.mix(docs, slots=None, tie_cols=("text",))


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("PII", masked_personal_data),
    ("mixing sources to target weights", mixture),
]

# The stages hold hashed models, a trained network and a scheduler with state,
# which SQL cannot express; tests/llm checks each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = land(docs, "stage")
    return docs
