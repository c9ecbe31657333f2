"""Paths from left-end to right-end labels, and the coordinates that they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakweave.config import LEAST_SUPPORT

CLUSTER = ["contig", "strand", "cluster"]


def paths(blocks: DataFrame, left_labels: DataFrame, right_labels: DataFrame) -> DataFrame:
    """``contig, strand, cluster, five, three, n``: how many blocks begin in one label and end in the other.

    blocks: ``left, right, n`` of each block of a cluster. labels: ``pos, label`` of a cluster's left and right ends. A
    path with one end is absorbed if another path shares that end; then paths of too few blocks go.
    """
    ends = blocks.groupBy(*CLUSTER, "left", "right").agg(F.sum("n").alias("n"))
    five = left_labels.select(*CLUSTER, F.col("pos").alias("left"), F.col("label").alias("five"))
    three = right_labels.select(*CLUSTER, F.col("pos").alias("right"), F.col("label").alias("three"))
    linked = ends.join(five, [*CLUSTER, "left"]).join(three, [*CLUSTER, "right"])
    counted = linked.where("five IS NOT NULL OR three IS NOT NULL").groupBy(*CLUSTER, "five", "three").agg(F.sum("n").alias("n"))
    shares = {side: F.count(F.lit(1)).over(W.partitionBy(*CLUSTER, side)) > 1 for side in ("five", "three")}
    marked = counted.withColumns({f"_{side}": shared for side, shared in shares.items()})
    absorbed = (F.col("three").isNull() & F.col("_five")) | (F.col("five").isNull() & F.col("_three"))
    return marked.where(~absorbed & (F.col("n") >= LEAST_SUPPORT)).drop("_five", "_three")


def coordinates(found: DataFrame, left_regions: DataFrame, right_regions: DataFrame, epsilon: int) -> DataFrame:
    """Paths with ``exons``: one or two intervals from the regions of their ends.

    If the regions touch or nearly do, the exon ends where the region that begins later ends, even where that lies within
    the other; if they overlap, at the later end of both; else there are two exons.
    """
    sides = {"five": left_regions, "three": right_regions}
    out = found
    for side, found_regions in sides.items():
        renamed = found_regions.select(*CLUSTER, F.col("label").alias(side), F.struct(F.col("lo").alias("start"), F.col("hi").alias("stop")).alias(f"_{side}"))
        out = out.join(renamed, [*CLUSTER, side], "left")
    five, three = F.col("_five"), F.col("_three")
    swap = three["start"] < five["start"]
    first, second = F.when(swap, three).otherwise(five), F.when(swap, five).otherwise(three)

    def one(start, stop):
        return F.array(F.struct(start.alias("start"), stop.alias("stop")))

    both = (
        F.when(F.abs(second["start"] - first["stop"]) <= epsilon, one(first["start"], second["stop"]))
        .when(second["start"] <= first["stop"], one(F.least(first["start"], second["start"]), F.greatest(first["stop"], second["stop"])))
        .otherwise(F.array(first, second))
    )
    alone = F.coalesce(five, three)
    exons = F.when(five.isNull() | three.isNull(), one(alone["start"], alone["stop"])).otherwise(both)
    return out.select(*found.columns, exons.alias("exons"))
