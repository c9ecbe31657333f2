"""What a run writes: transcripts as GTF, counts by gene, and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakweave.config import Config
from peakweave.sources.shared import write_text_file

HEADER = ("##description: transcripts found by density of aligned 3' ends", "##provider: peakweave", "##format: gtf", "##parameters: {parameters}")
GTF_COLUMNS = ("seqname", "source", "feature", "start", "stop", "score", "strand", "frame", "attributes")


def _strand(config: Config) -> Column:
    return F.when(F.col("strand") == (1 if config.strandedness == "forward" else 0), "-").otherwise("+")


def gtf_rows(transcripts: DataFrame, config: Config) -> DataFrame:
    """A gene row for each cluster, then a row for each transcript and its exons, with their order ``cluster, tx_ix, exon_ix``.

    Positions are from 1, but for the region of a gene row, which is from 0. Transcripts: with ``status, gene`` if an
    annotation was given.
    """
    if "status" not in transcripts.columns:
        transcripts = transcripts.withColumn("status", F.lit("unassigned")).withColumn("gene", F.lit(None).cast("struct<gene_id:string,run:long>"))
    starts, stops = F.expr("exons[0].start"), F.expr("element_at(exons, -1).stop")
    named = F.when(F.col("status") == "assigned", F.col("gene.gene_id")).otherwise(F.initcap("status"))
    told = transcripts.select("*", starts.alias("tx_start"), stops.alias("tx_stop"), named.alias("assigned_to"))
    whole = told.groupBy("contig", "strand", "cluster", "stop", "read_count").agg(F.min("tx_start").alias("start"), F.max("tx_stop").alias("end"), F.count(F.lit(1)).alias("n"))
    ids = whole.select("contig", "strand", "cluster", F.concat(F.lit(f"{config.prefix}."), "contig", F.lit(":"), F.col("start") + 1, F.lit("-"), F.col("end") + 1).alias("gid"))
    place = ["contig", "strand", "cluster"]

    def row(df: DataFrame, feature: str, a: Column, b: Column, attributes: Column, tx: Column, exon: Column) -> DataFrame:
        fixed = [F.col("contig").alias("seqname"), F.lit("peakweave").alias("source"), F.lit(feature).alias("feature"), (a + 1).alias("start"), (b + 1).alias("stop"), F.lit(".").alias("score"), _strand(config).alias("strand"), F.lit(".").alias("frame")]
        return df.select(*fixed, attributes.alias("attributes"), F.col("cluster"), tx.cast("int").alias("tx_ix"), exon.cast("int").alias("exon_ix"))

    gene = F.format_string('gene_id "%s"; region "%s:%d-%d"; reads "%d"; transcripts "%d";', "gid", "contig", "cluster", "stop", "read_count", "n")
    genes = row(whole.join(ids, place), "gene", F.col("start"), F.col("end"), gene, F.lit(-1), F.lit(-1))
    each = told.join(ids, place)
    tx_id = F.concat("gid", F.lit("."), F.col("tx_ix"))
    tx = F.concat(F.lit('gene_id "'), "gid", F.lit('"; transcript_id "'), tx_id, F.lit('"; counts "'), F.format_number(F.col("counts").cast("float"), 2), F.lit('"; assigned "'), "assigned_to", F.lit('";'))
    rows = row(each, "transcript", F.col("tx_start"), F.col("tx_stop"), tx, F.col("tx_ix"), F.lit(-1))
    exons = each.select("contig", "strand", "cluster", "gid", "tx_ix", F.posexplode("exons").alias("exon_ix", "e"))
    exon = F.concat(F.lit('gene_id "'), "gid", F.lit('"; transcript_id "'), tx_id, F.lit('"; exon_number "'), F.col("exon_ix"), F.lit('";'))
    return genes.unionByName(rows).unionByName(row(exons, "exon", F.col("e.start"), F.col("e.stop"), exon, F.col("tx_ix"), F.col("exon_ix")))


def gtf_lines(rows: DataFrame, config: Config) -> DataFrame:
    """The text of a GTF, header first, then by contig, cluster, strand, transcript and exon, in one global order."""
    told = f"window {config.window_size} epsilon {config.epsilon} min_count {config.min_count} strandedness {config.strandedness}"
    header = rows.sparkSession.createDataFrame([(k, h.format(parameters=told)) for k, h in enumerate(HEADER)], "_place int, value string")
    order = ["seqname", "cluster", "strand", "tx_ix", "exon_ix"]
    lines = rows.select(F.lit(len(HEADER)).alias("_place"), F.concat_ws("\t", *GTF_COLUMNS).alias("value"), *order)
    return header.unionByName(lines, allowMissingColumns=True).orderBy("_place", *order).select("value")


def write_gtf(rows: DataFrame, path: str, config: Config) -> None:
    """One GTF file."""
    write_text_file(gtf_lines(rows, config), path)


def cluster_lines(clusters: DataFrame) -> DataFrame:
    """Clusters as text: contig, start, stop and reads between tabs, strand by strand."""
    return clusters.orderBy("contig", "strand", "start").select(F.concat_ws("\t", "contig", "start", "stop", "read_count").alias("value"))


def gene_lines(genes: DataFrame) -> DataFrame:
    """Genes as text: contig, id and exons between spaces, both strands in one order."""
    spans = F.transform("exons", lambda e: F.concat(e["start"], F.lit("-"), e["stop"]))
    return genes.orderBy("contig", "start", "strand", "gene_id").select(F.concat_ws(" ", "contig", "gene_id", spans).alias("value"))


def count_rows(counts: DataFrame) -> DataFrame:
    """Gene counts as text rows ``gene_id <tab> count``, both strands in one order."""
    shown = F.format_string("%.6g", F.col("reads"))
    shown = F.when(F.contains(shown, F.lit("e")), shown).otherwise(F.regexp_replace(shown, r"(\.\d*[1-9])0+$|\.0+$", "$1"))
    return counts.orderBy("contig", "start", "strand", "gene_id").select(F.concat_ws("\t", "gene_id", shown).alias("value"))


def summary_rows(counts: DataFrame) -> DataFrame:
    """The summary's one row of totals as ``metric, value`` rows, in order."""
    shown = {"assigned": "%.2f", "unassigned": "%.2f", "ambiguous": "%.2f", "multimapping": "%d", "low_quality": "%d", "total": "%d", "transcripts": "%d"}
    rows = [F.struct(F.lit(k).alias("place"), F.lit(name).alias("metric"), F.format_string(f, F.col(name).cast("double" if "f" in f else "long")).alias("value")) for k, (name, f) in enumerate(shown.items())]
    return counts.select(F.inline(F.array(*rows)))
