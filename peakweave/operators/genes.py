"""Genes of an annotation: runs of lines, unions of exons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakweave.operators.intervals import interval_union, ordered_runs


def gene_lines(annotation: DataFrame) -> DataFrame:
    """``contig, strand`` (0 forward, 1 reverse)``, gene_id, start, stop, line_no`` of parsed annotation lines."""
    return annotation.select(F.col("seqname").alias("contig"), (F.col("strand") == "-").cast("int").alias("strand"), "gene_id", "start", "stop", "line_no")


def exon_union(lines: DataFrame) -> DataFrame:
    """``contig, strand, gene_id, run, start, stop``: a gene is a run of neighbouring lines of one id on a contig and strand."""
    runs = ordered_runs(lines, ["contig", "strand"], ["line_no"], "gene_id")
    return interval_union(runs, ["contig", "strand", "gene_id", "run"])


def gene_table(exons: DataFrame) -> DataFrame:
    """A row per gene: ``contig, strand, gene_id, run, start, stop, exons``."""
    listed = F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("exons")
    return exons.groupBy("contig", "strand", "gene_id", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), listed)


def feature_count(annotation: DataFrame) -> DataFrame:
    return annotation.agg(F.count(F.lit(1)).alias("features"))


def interleaved(genes: DataFrame) -> DataFrame:
    """Both strands' genes in one order: contig, start, strand, id."""
    order = W.partitionBy("contig").orderBy("start", "strand", "gene_id")
    return genes.withColumn("place", F.row_number().over(order))
