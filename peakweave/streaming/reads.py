"""Reads as they arrive: the stateless tests, and running totals of rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peakweave.config import Config
from peakweave.operators import reads
from peakweave.schemas import READS


def open_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder of reads."""
    return spark.readStream.schema(READS).parquet(folder)


def judged(stream: DataFrame, config: Config) -> DataFrame:
    """The stream with ``reject_reason`` and ``strand``; needs no state."""
    return reads.judged(stream, config)


def reject_totals(stream: DataFrame, config: Config) -> DataFrame:
    """Running totals for each contig (complete or update mode); its state is a row per contig."""
    return reads.reject_summary(stream, config)
