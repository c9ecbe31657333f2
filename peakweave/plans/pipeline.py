"""The whole run: reads to transcripts, and with an annotation to gene counts and a summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakweave.config import Config
from peakweave.operators import assign, chains, density, genes, linking, reads, sessions
from peakweave.sources.shared import materialise

CLUSTER = linking.CLUSTER


@dataclass(frozen=True)
class Found:
    """What a run finds, stage by stage. Blocks, clusters and paths are written once; several stages read them."""

    alignments: DataFrame
    clusters: DataFrame
    blocks: DataFrame
    paths: DataFrame
    transcripts: DataFrame


def clusters_of(found: DataFrame, config: Config) -> DataFrame:
    """The clusters of alignments."""
    return sessions.clusters(sessions.anchored_islands(found, config.window_size), config.window_size)


def crowding() -> Column:
    """Reads for each position of a cluster, in single precision."""
    return F.col("read_count").cast("float") / (F.col("stop") - F.col("start")).cast("float")


def too_dense(clusters: DataFrame, config: Config) -> DataFrame:
    """The clusters of enough reads that the density threshold leaves out; none without a threshold."""
    kept = clusters.where(F.col("read_count") >= config.least_reads)
    return kept.where(crowding() >= config.density_threshold if config.density_threshold else F.lit(False))


def eligible(clusters: DataFrame, config: Config) -> DataFrame:
    """Clusters of enough reads and, if there is a threshold, of a density below it, with the neighbours that make a core."""
    kept = clusters.where(F.col("read_count") >= config.least_reads)
    if config.density_threshold:
        kept = kept.where(crowding() < config.density_threshold)
    return kept.withColumn("least", density.least_neighbours(F.col("read_count"), config.count_percentage))


def labels(blocks: DataFrame, clusters: DataFrame, config: Config) -> DataFrame:
    """Labelled block ends of the eligible clusters: ``contig, strand, cluster, side, pos, n, neighbours, core, label``; side: left or right."""
    ends = F.inline(F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("pos")) for side in ("left", "right"))))
    counted = blocks.select(*CLUSTER, "n", ends).groupBy(*CLUSTER, "side", "pos").agg(F.sum("n").alias("n"))
    return density.dbscan_1d(counted.join(eligible(clusters, config).select(*CLUSTER, "least"), CLUSTER), [*CLUSTER, "side"], config.epsilon, "least")


def side_of(labelled: DataFrame, side: str) -> DataFrame:
    return labelled.where(F.col("side") == side).drop("side")


def found_paths(blocks: DataFrame, clusters: DataFrame, config: Config) -> DataFrame:
    labelled = materialise(labels(blocks, clusters, config), "labels")
    left, right = side_of(labelled, "left"), side_of(labelled, "right")
    linked = linking.paths(blocks, left, right)
    return linking.coordinates(linked, density.regions(left, CLUSTER), density.regions(right, CLUSTER), config.epsilon)


def find(reads_: DataFrame, config: Config) -> Found:
    found = materialise(reads.alignments(reads_, config), "alignments")
    wholes = materialise(clusters_of(found, config), "clusters")
    placed = materialise(reads.spliced(sessions.with_cluster(found, wholes, config.window_size)), "spliced")
    blocks = reads.blocks(placed)
    linked = materialise(found_paths(blocks, wholes, config), "paths")
    crossed = reads.junctions(placed).select(*CLUSTER, "junction").distinct()
    overlapped = chains.overlap_clusters(linked, crossed, config.epsilon)
    collapsed = chains.collapse_clusters(overlapped, wholes, config.epsilon)
    return Found(found, wholes, blocks, linked, materialise(chains.transcripts(collapsed), "transcripts"))


def assigned(found: Found, exons: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(transcripts, single reads) with ``status, gene, gene_strand``. Reads stand alone in clusters that have no path of their own."""
    other = 1 - F.col("strand") if config.strandedness == "reverse" else F.col("strand")
    tx = assign.assign_transcripts(found.transcripts, exons, config).withColumn("gene_strand", other)
    alone = found.blocks.join(found.paths.select(*CLUSTER).distinct(), CLUSTER, "left_anti")
    return tx, assign.assign_reads(alone, exons, config).withColumn("gene_strand", other)


def counted(reads_: DataFrame, annotation: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transcripts, gene counts, summary) of a run with an annotation."""
    found = find(reads_, config)
    exons = genes.exon_union(genes.gene_lines(annotation))
    tx, single = assigned(found, exons, config)
    weights = [df.select("contig", "status", "gene", "gene_strand", F.col(w).cast("double").alias("w")) for df, w in ((tx, "counts"), (single, "n"))]
    both = weights[0].unionByName(weights[1])
    by_gene = assign.gene_counts(genes.gene_table(exons), both, "w")
    sums = both.agg(*(F.coalesce(F.sum(F.when(F.col("status") == s, F.col("w"))), F.lit(0.0)).alias(s) for s in ("assigned", "unassigned", "ambiguous")))
    rejects = reads.reject_summary(reads_.where("contig IS NOT NULL"), config).agg(F.sum("multimapped").alias("multimapping"), F.sum("low_quality").alias("low_quality"), F.sum("total").alias("total"))
    lone = tx.agg(F.count(F.lit(1)).alias("transcripts"))
    return tx, by_gene, sums.join(rejects, F.lit(True)).join(lone, F.lit(True))  # one row each
