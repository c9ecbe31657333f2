"""One-dimensional density clustering with RANGE windows, on counted positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakweave.config import LEAST_SUPPORT


def least_neighbours(reads: Column, percentage: int) -> Column:
    """How many neighbours make a core point: a share of the cluster's reads, cut to an integer, and ten at least."""
    return F.greatest((reads * F.lit(percentage / 100.0)).cast("int"), F.lit(LEAST_SUPPORT))


def range_neighbours(counted: DataFrame, keys: Sequence[str], epsilon: int, pos: str = "pos", n: str = "n") -> DataFrame:
    """Counted positions with ``neighbours``: how many other points lie within ``epsilon`` of a point there."""
    near = W.partitionBy(*keys).orderBy(pos).rangeBetween(-epsilon, epsilon)
    return counted.withColumn("neighbours", F.sum(n).over(near) - 1)


def dbscan_1d(counted: DataFrame, keys: Sequence[str], epsilon: int, least: str, pos: str = "pos", n: str = "n") -> DataFrame:
    """Counted positions with ``core`` and ``label``, numbered from 0 from left to right in each key; null for noise.

    Cores not more than ``epsilon`` apart share a label. Another point takes the label of the nearest core at its left if
    that is within reach, else of the nearest at its right, else none.
    """
    order = W.partitionBy(*keys).orderBy(pos)
    seen = range_neighbours(counted, keys, epsilon, pos, n).withColumn("core", F.col("neighbours") >= F.col(least))
    seen = seen.withColumn("_core", F.when(F.col("core"), F.col(pos)))
    # the cores next to a point: offsets that skip nulls walk on from row to row, where a frame to the end would start again at each
    along = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {pos})"
    left, right = F.expr(f"lag(_core) IGNORE NULLS {along}"), F.expr(f"lead(_core) IGNORE NULLS {along}")
    new = F.when(F.col("core"), F.when(F.col(pos) - F.col("_left") <= epsilon, 0).otherwise(1)).otherwise(0)
    marked = seen.withColumns({"_left": left, "_right": right}).withColumn("_new", new)
    marked = marked.withColumn("_label", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - 1)
    reached_left, reached_right = F.col(pos) - F.col("_left") <= epsilon, F.col("_right") - F.col(pos) <= epsilon
    # a point beyond the left core's reach lies before the first core of the next label
    label = F.when(F.col("core") | reached_left, F.col("_label")).when(reached_right, F.col("_label") + 1)
    return marked.withColumn("label", label.cast("int")).drop("_core", "_left", "_new", "_label", "_right")


def regions(labelled: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """The span of each label's core points: ``keys, label, lo, hi``."""
    return labelled.where("core").groupBy(*keys, "label").agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"))
