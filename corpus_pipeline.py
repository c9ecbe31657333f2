"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes the documents that its predecessor kept and gives those that it
keeps, with the columns of documents; the last gives packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakweave.llm import decontamination, line_dedup, packing, quality, simhash
from peakweave.llm._shared import materialise, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score is below the threshold. A null or empty text has a score like any other; repeated rows share theirs."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def line_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without recurring lines; every row stays, null texts as they are, and ``n_chars``, where there is one, tells the new length (null text: 0)."""
    thinned = line_dedup.without_recurring(docs)
    if "n_chars" not in docs.columns:
        return thinned
    count = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return thinned.withColumn("n_chars", count)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the smallest id. Null and empty texts are copies of one another; rows without an id stay."""
    return simhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose text holds a benchmark item. Null and empty texts hold none."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def differencing_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences. A null text is empty and still has its end token."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_templates", line_templates),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("differencing_packing", differencing_packing),
]

#: Latent-semantic votes, template trees and tokenizer ids are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
