"""The command line: ``python -m peakweave.plans.cli reads.bam -a genes.gtf -o out``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from peakweave.config import Config
from peakweave.plans import pipeline
from peakweave.sources import annotation, bam, sam, sinks
from peakweave.sources.shared import remove_intermediates, write_text_file
from peakweave.sources.shipping import ship

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="peakweave", description="Transcripts and gene counts from aligned 3' reads.")
    p.add_argument("reads", help="a .bam with its .bai (or a pattern of several), a .sam, or a Parquet table of reads")
    p.add_argument("-t", "--threads", type=int, default=1, help="accepted for familiarity; Spark's cores are set by its master")
    p.add_argument("-a", "--annotation", default="", help=".gtf or .gff")
    p.add_argument("-s", "--strandedness", choices=("forward", "reverse"), default="forward")
    p.add_argument("-n", "--nonunique-alignments", action="store_true")
    p.add_argument("-q", "--mapq-min", type=int, default=1)
    p.add_argument("-w", "--window-size", type=int, default=1000)
    p.add_argument("-m", "--min-count", type=int, default=25)
    p.add_argument("-p", "--count-percentage", type=int, default=5)
    p.add_argument("-e", "--epsilon", type=int, default=50)
    p.add_argument("-d", "--density-threshold", type=float, default=0.0)
    p.add_argument("-f", "--feature-tag", default="exon")
    p.add_argument("-u", "--utr-tag", default="UTR")
    p.add_argument("-i", "--feature-id", default="gene_id")
    p.add_argument("-o", "--output-gtf", default="")
    p.add_argument("--version", action="version", version=VERSION)
    return p


def config_of(args: argparse.Namespace) -> Config:
    named = {k: v for k, v in vars(args).items() if k not in ("reads", "threads")}
    return Config(**named | {"output_gtf": args.output_gtf or f"{args.reads}.gtf"})


def open_reads(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".bam") or "*" in path:
        ship(spark)
        spark.dataSource.register(bam.BamSource)
        return spark.read.format("bam").option("order", "coordinate").load(path)
    return sam.read_sam(spark, path)[0] if path.endswith(".sam") else spark.read.parquet(path)


def run(spark: SparkSession, path: str, config: Config) -> DataFrame | None:
    """Writes the GTF and, with an annotation, gene counts beside it; gives the summary's rows or None."""
    reads = open_reads(spark, path)
    if not config.annotation:
        sinks.write_gtf(sinks.gtf_rows(pipeline.find(reads, config).transcripts, config), config.output_gtf, config)
        return None
    lines = annotation.read_annotation(spark, config.annotation, config)
    transcripts, counts, summary = pipeline.counted(reads, lines, config)
    sinks.write_gtf(sinks.gtf_rows(transcripts, config), config.output_gtf, config)
    write_text_file(sinks.count_rows(counts), f"{config.output_gtf}.counts")
    return sinks.summary_rows(summary)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        config = config_of(args)
        spark = SparkSession.builder.appName("peakweave").getOrCreate()
        for row in (rows := run(spark, args.reads, config)) and rows.collect() or []:
            print(f"{row.metric}\t{row.value}")
        remove_intermediates(spark)
    except (ValueError, OSError) as error:
        print(f"peakweave: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
