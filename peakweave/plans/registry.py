"""Every query of the peak and interval operators, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakweave.config import Config
from peakweave.functions.alignment import mirrored
from peakweave.operators import assign, density, genes, intervals, linking, reads, sessions
from peakweave.plans import pipeline
from peakweave.plans.oracle import ORACLE_SQL as ORACLE_SQL
from peakweave.sources import annotation, derived, sinks
from peakweave.sources.shared import materialise

CONFIG = Config()
DENSE = Config(density_threshold=0.2)
#: No cluster holds so many reads, so that every read of a run is assigned by itself.
UNSEARCHED = 2**31 - 1
CLUSTER = linking.CLUSTER
Query = Callable[[SparkSession, str], DataFrame]


def _alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.alignments(derived.reads(spark, sf_dir), CONFIG)


def _clustered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(clusters, blocks with their cluster)."""
    found = materialise(_alignments(spark, sf_dir), "alignments")
    wholes = materialise(pipeline.clusters_of(found, CONFIG), "clusters")
    return wholes, reads.blocks(materialise(reads.spliced(sessions.with_cluster(found, wholes, CONFIG.window_size)), "spliced"))


def _labels(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    wholes, blocks = _clustered(spark, sf_dir)
    return pipeline.side_of(pipeline.labels(blocks, wholes, CONFIG), side)


def _paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    wholes, blocks = _clustered(spark, sf_dir)
    return wholes, materialise(pipeline.found_paths(blocks, wholes, CONFIG), "paths")


def _exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genes.exon_union(derived.gene_lines(spark, sf_dir))


def _flat(df: DataFrame) -> DataFrame:
    """The one or two exons of a path as plain columns."""
    parts = {f"{end}{k + 1}": F.get("exons", F.lit(k))[end] for k in (0, 1) for end in ("start", "stop")}
    return df.withColumns(parts).drop("exons")


def read_reject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.reject_summary(derived.reads(spark, sf_dir), CONFIG)


def nonunique_reject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where reads of several hits are let in."""
    return reads.reject_summary(derived.reads(spark, sf_dir), Config(nonunique_alignments=True))


def contig_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derived.reads(spark, sf_dir)
    return reads.contigs(found).join(found.groupBy("contig").agg(F.count(F.lit(1)).alias("reads")), "contig")


def splice_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.blocks(_alignments(spark, sf_dir))


def splice_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.junctions(_alignments(spark, sf_dir)).groupBy("contig", "strand", "junction").agg(F.sum("n").alias("n"))


def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.anchored_islands(_alignments(spark, sf_dir), CONFIG.window_size)


def read_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.clusters(gap_islands(spark, sf_dir), CONFIG.window_size)


def cluster_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.eligible(read_clusters(spark, sf_dir), DENSE).select(*CLUSTER, "read_count", "least")


def dense_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.too_dense(read_clusters(spark, sf_dir), DENSE).select(*CLUSTER, "read_count")


def block_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least and the greatest position of each alignment's blocks."""
    points = reads.spliced(_alignments(spark, sf_dir))
    return points.select("contig", "strand", "pos", "cigar", F.array_min("points").alias("least"), F.array_max("points").alias("greatest"))


def range_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir, "left").select(*CLUSTER, "pos", "n", "neighbours")


def dbscan_labels_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir, "left").select(*CLUSTER, "pos", "n", "neighbours", "core", "label")


def dbscan_labels_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir, "right").select(*CLUSTER, "pos", "n", "neighbours", "core", "label")


def dbscan_regions_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.regions(_labels(spark, sf_dir, "left"), CLUSTER)


def dbscan_regions_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.regions(_labels(spark, sf_dir, "right"), CLUSTER)


def peak_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir)[1].drop("exons")


def peak_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_paths(spark, sf_dir)[1])


def mirror_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _paths(spark, sf_dir)[1]
    return _flat(found.withColumn("exons", mirrored(F.col("exons"))).drop("n"))


def _path_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.struct("cluster", "five", "three").alias("path")  # a null end is an end like any other
    found = _paths(spark, sf_dir)[1].select("contig", "strand", named, "exons")
    return assign.transcript_scores(found, _exons(spark, sf_dir), ["contig", "strand", "path"])


def path_gene_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path_scores(spark, sf_dir).select("contig", "strand", "path.*", F.col("gene.gene_id").alias("gene_id"), "score")


def path_gene_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.unique_argmax(_path_scores(spark, sf_dir), ["contig", "strand", "path"], "score", "gene")
    return found.select("contig", "strand", "path.*", "status", "best")


def ratio_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    wholes, found = _paths(spark, sf_dir)
    shared = intervals.ratio_allocate(found.join(wholes.select(*CLUSTER, "read_count"), CLUSTER), CLUSTER, "n", "read_count")
    return shared.select(*CLUSTER, "five", "three", F.round("share", 6).alias("share"))


def gene_exon_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exons(spark, sf_dir).drop("run")


def gene_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = genes.gene_table(_exons(spark, sf_dir))
    return found.select("contig", "strand", "gene_id", "start", "stop", F.size("exons").cast("long").alias("n_exons"))


def _gtf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived annotation as GTF text."""
    text = F.concat_ws("\t", "contig", F.lit("derived"), F.lit("exon"), F.col("start") + 1, F.col("stop") + 1, F.lit("."), F.when(F.col("strand") == 1, "-").otherwise("+"), F.lit("."), F.concat(F.lit('ref_gene_id "none"; gene_id "'), "gene_id", F.lit('";')))
    return derived.gene_lines(spark, sf_dir).select("line_no", text.alias("value"))


def annotation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotation.parsed(_gtf_lines(spark, sf_dir), CONFIG)
    return found.select("seqname", (F.col("strand") == "-").cast("int").alias("strand"), "gene_id", "start", "stop")


def feature_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genes.feature_count(annotation.parsed(_gtf_lines(spark, sf_dir), CONFIG))


def strand_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genes.interleaved(genes.gene_table(_exons(spark, sf_dir))).select("contig", "strand", "gene_id", "start", "place")


def _written_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.blocks(materialise(reads.spliced(_alignments(spark, sf_dir)), "spliced"))


def read_gene_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign.assign_reads(_written_blocks(spark, sf_dir), _exons(spark, sf_dir), CONFIG)
    return found.select("contig", "strand", "pos", "cigar", "n", "status", F.col("gene.gene_id").alias("gene_id"))


def distinct_gene_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads by the one best gene, however many of their blocks it holds."""
    found = assign.assign_reads(_written_blocks(spark, sf_dir), _exons(spark, sf_dir), Config(count_distinct_genes=True))
    return found.select("contig", "strand", "pos", "cigar", "n", "status", F.col("gene.gene_id").alias("gene_id"))


def read_status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_gene_assignment(spark, sf_dir).groupBy("contig", "status").agg(F.sum("n").alias("reads"))


def gene_read_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    exons = _exons(spark, sf_dir)
    found = assign.assign_reads(_written_blocks(spark, sf_dir), exons, CONFIG).withColumn("gene_strand", F.col("strand"))
    return assign.gene_counts(genes.gene_table(exons), found, "n").select("contig", "strand", "gene_id", "reads")


def reverse_strand_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments that begin within a gene's span on the strand that a reverse-stranded library reads it from."""
    extents = genes.gene_table(_exons(spark, sf_dir)).drop("exons", "run")
    facing = assign.facing(extents, Config(strandedness="reverse"))
    begun = _alignments(spark, sf_dir).groupBy("contig", "strand", "pos").agg(F.sum("n").alias("n")).withColumn("end", F.col("pos"))
    hits = intervals.interval_join(begun, facing, ["contig", "strand"], ("pos", "end"), ("start", "stop")).groupBy("contig", "strand", "gene_id").agg(F.sum("n").alias("reads"))
    counts = facing.join(hits, ["contig", "strand", "gene_id"], "left")
    return counts.select("contig", (1 - F.col("strand")).alias("strand"), "gene_id", "start", "stop", F.coalesce("reads", F.lit(0)).cast("long").alias("reads"))


def closest_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _alignments(spark, sf_dir).select("contig", "strand", "pos").distinct()
    return intervals.first_ending_at_or_after(points, genes.gene_table(_exons(spark, sf_dir)), ["contig", "strand"], "pos", "gene_id")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generic islands on another domain: runs of a user's events at most an hour apart."""
    points = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("pos"))
    found = intervals.gap_islands(points, ["user_id"], "pos", 3600)
    return found.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"))


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.find(derived.reads(spark, sf_dir), CONFIG).transcripts


def transcript_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transcripts(spark, sf_dir)


def gtf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.gtf_rows(_transcripts(spark, sf_dir), CONFIG)


def _counted(spark: SparkSession, sf_dir: str, config: Config = CONFIG) -> tuple[DataFrame, DataFrame, DataFrame]:
    return pipeline.counted(derived.reads(spark, sf_dir), annotation.parsed(_gtf_lines(spark, sf_dir), config), config)


def _run_counts(spark: SparkSession, sf_dir: str, config: Config) -> DataFrame:
    return _counted(spark, sf_dir, config)[1].select("contig", "strand", "gene_id", F.round("reads", 6).alias("reads"))


def full_pipeline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_counts(spark, sf_dir, CONFIG)


def reverse_pipeline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_counts(spark, sf_dir, Config(strandedness="reverse"))


def unsearched_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene counts of a whole run in which every read stands alone."""
    return _run_counts(spark, sf_dir, Config(min_count=UNSEARCHED))


def unsearched_reverse_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_counts(spark, sf_dir, Config(min_count=UNSEARCHED, strandedness="reverse"))


def unsearched_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.summary_rows(_counted(spark, sf_dir, Config(min_count=UNSEARCHED))[2])


def high_count_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run in which some clusters are searched for transcripts and the reads of the others stand alone."""
    return sinks.summary_rows(_counted(spark, sf_dir, Config(min_count=600))[2])


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.summary_rows(_counted(spark, sf_dir)[2])


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        read_reject_summary, contig_catalogue, splice_blocks, splice_junctions, gap_islands, read_clusters, cluster_density, dense_clusters, block_spans, range_neighbours,
        dbscan_labels_left, dbscan_labels_right, dbscan_regions_left, dbscan_regions_right, peak_paths, peak_coordinates, mirror_intervals,
        path_gene_overlap, path_gene_assignment, ratio_allocation, gene_exon_union, gene_extents, annotation_lines, feature_count, strand_interleave,
        read_gene_assignment, read_status_totals, gene_read_counts, reverse_strand_counts, closest_interval, event_sessions, transcript_chains,
        gtf_rows, full_pipeline_counts, run_summary, reverse_pipeline_counts, high_count_run_summary, unsearched_run_counts, unsearched_reverse_run_counts,
        unsearched_run_summary, distinct_gene_assignment, nonunique_reject_summary,
    )
}
