"""Anchored windows over positions, and the clusters that they collapse to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakweave.operators.intervals import gap_islands

PLACE = ["contig", "strand"]


def anchored_islands(found: DataFrame, window: int) -> DataFrame:
    """Islands of alignments: ``contig, strand, island`` (its first position), ``last_anchor, read_count``.

    Greedy windows of ``window`` open at the first position beyond the last one. A gap longer than a window always ends
    one, so islands are found by gaps, and only the last anchor needs a fold, over an island's distinct positions.
    """
    counted = found.groupBy(*PLACE, "pos").agg(F.sum("n").alias("n"))
    islands = gap_islands(counted, PLACE, "pos", window)
    fold = F.aggregate(F.array_sort("places"), F.col("island"), lambda a, p: F.when(p > a + window, p).otherwise(a))
    folded = islands.groupBy(*PLACE, "island").agg(F.collect_list("pos").alias("places"), F.sum("n").alias("read_count"))
    return folded.select(*PLACE, "island", fold.alias("last_anchor"), "read_count")


def clusters_of(islands: DataFrame, window: int) -> DataFrame:
    """Islands with ``cluster``: the first position of the cluster that they collapse to. Windows at most a window apart are joined."""
    along = W.partitionBy(*PLACE).orderBy("island")
    before = F.lag("last_anchor").over(along)
    start = F.when(before.isNull() | (F.col("island") - before > 2 * window), F.col("island"))
    return islands.withColumn("_start", start).withColumn("cluster", F.max("_start").over(along.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_start")


def clusters(islands: DataFrame, window: int) -> DataFrame:
    """``contig, strand, cluster, start, stop, read_count``; a cluster ends where its last window does."""
    grouped = clusters_of(islands, window).groupBy(*PLACE, "cluster")
    return grouped.agg(F.min("island").alias("start"), (F.max("last_anchor") + window).cast("int").alias("stop"), F.sum("read_count").alias("read_count"))


def with_cluster(found: DataFrame, clustered: DataFrame, window: int) -> DataFrame:
    """Alignments with the ``cluster`` that their position lies in; an equality join on bins of positions."""
    width = max(1, 16 * window)
    spans = clustered.select(*PLACE, "cluster", F.col("stop").alias("_stop"))
    filed = spans.withColumn("_bin", F.explode(F.sequence(F.expr(f"cluster div {width}"), F.expr(f"_stop div {width}"))))
    at = found.withColumn("_bin", F.expr(f"pos div {width}"))
    return at.join(filed, [*PLACE, "_bin"]).where("pos BETWEEN cluster AND _stop").drop("_bin", "_stop")
