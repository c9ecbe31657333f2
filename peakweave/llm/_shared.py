"""What the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peakweave.sources.shared import mapped, materialise, shared_dir, shared_path
from peakweave.sources.shipping import ship

__all__ = ["fits", "mapped", "materialise", "shared_dir", "shared_path", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits(df: DataFrame, rows: int) -> bool:
    """Whether a written table has at most so many rows; its files know."""
    return df.count() <= rows
