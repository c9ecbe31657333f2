"""Assignment of transcripts and reads to genes, by the one best match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakweave.config import Config
from peakweave.operators.intervals import interval_join, unique_argmax

GENE = ["contig", "strand", "gene_id", "run"]


def facing(df: DataFrame, config: Config) -> DataFrame:
    """Genes as seen by reads: in a reverse-stranded library, on the other strand."""
    return df.withColumn("strand", 1 - F.col("strand")) if config.strandedness == "reverse" else df


def block_score(left: Column, right: Column, start: Column, stop: Column) -> Column:
    """2 if the exon holds both ends of the block, 1 if it holds one, else 0 (also for an exon inside the block)."""
    holds = lambda x: x.between(start, stop).cast("int")
    return holds(left) + holds(right)


def transcript_scores(transcripts: DataFrame, exons: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, gene, score``: the length that a transcript's exons share with a gene's; one shared base counts as none.

    transcripts: ``keys, exons``; exons: of exon_union, strands already facing.
    """
    parts = transcripts.select(*keys, F.inline("exons").alias("seg_start", "seg_stop"))
    right = exons.select("contig", "strand", F.struct("gene_id", "run").alias("gene"), "start", "stop")
    shared = F.least("seg_stop", "stop") - F.greatest("seg_start", "start")
    pairs = interval_join(parts, right, ["contig", "strand"], ("seg_start", "seg_stop"), ("start", "stop"))
    return pairs.groupBy(*keys, "gene").agg(F.sum(F.greatest(shared, F.lit(0))).cast("long").alias("score"))


def read_scores(blocks: DataFrame, exons: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, block_ix, gene, score``: how well each exon of a gene holds each block. blocks: ``keys, block_ix, left, right``."""
    right = exons.select("contig", "strand", F.struct("gene_id", "run").alias("gene"), "start", "stop")
    pairs = interval_join(blocks, right, ["contig", "strand"], ("left", "right"), ("start", "stop"))
    return pairs.select(*keys, "block_ix", "gene", block_score(F.col("left"), F.col("right"), F.col("start"), F.col("stop")).alias("score"))


def best_genes(things: DataFrame, scores: DataFrame, keys: list[str], row: list[str] | None = None) -> DataFrame:
    """``things`` with ``status`` (assigned, ambiguous, unassigned) and ``gene``; things that no gene meets are unassigned."""
    found = unique_argmax(scores, keys, "score", "gene", row or []).withColumnRenamed("value", "gene").drop("best")
    joined = things.join(found, keys, "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("unassigned")))


def assign_reads(blocks: DataFrame, exons: DataFrame, config: Config) -> DataFrame:
    """Alignments ``contig, strand, pos, cigar, n`` with ``status, gene``. All blocks and genes of a read compete: two blocks
    that a gene holds equally well make it ambiguous, unless the configuration counts genes."""
    keys = ["contig", "strand", "pos", "cigar"]
    scores = read_scores(blocks.select(*keys, "block_ix", "left", "right"), facing(exons, config), keys)
    whole = blocks.where("block_ix = 0").select(*keys, "n")  # one row for each alignment
    return best_genes(whole, scores, keys, [] if config.count_distinct_genes else ["block_ix"])


def assign_transcripts(transcripts: DataFrame, exons: DataFrame, config: Config) -> DataFrame:
    keys = ["contig", "strand", "cluster", "tx_ix"]
    return best_genes(transcripts, transcript_scores(transcripts, facing(exons, config), keys), keys)


def gene_counts(genes: DataFrame, assigned: DataFrame, weight: str) -> DataFrame:
    """``contig, strand, gene_id, run, reads`` of every gene, those without reads too."""
    sums = assigned.where("status = 'assigned'").groupBy(F.col("contig"), F.col("gene.gene_id").alias("gene_id"), F.col("gene.run").alias("run"), F.col("gene_strand").alias("strand"))
    joined = genes.select(*GENE, "start").join(sums.agg(F.sum(weight).cast("double").alias("reads")), GENE, "left")
    return joined.withColumn("reads", F.coalesce("reads", F.lit(0.0)))
