"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. Tables such as labels and benchmark are read from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitlane.llm import decontam, mixing, near_dup, quality, token_files
from pitlane.llm.queries import vocabulary
from pitlane.llm.tables import bounded_batches, table
from pitlane.session import cut

#: Shares of all tokens after the mix: little that looks poor or toxic, the rest clean.
TARGETS = {"clean": 0.95, "poor": 0.01, "toxic": 0.04}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    bounded_batches(spark)
    return quality.keep(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    bounded_batches(spark)
    return near_dup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go; elsewhere such spans are cut out."""
    bounded_batches(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as the mix asks, so a document may stay out or come twice."""
    bounded_batches(spark)
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), TARGETS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID files, and one row per document read back from them."""
    bounded_batches(spark)
    return token_files.token_digest(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_weights),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs


#: Trained posteriors and a tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None
