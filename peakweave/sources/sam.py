"""Alignments in SAM text, and what a SAM or BAM header says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakweave.schemas import CONTIGS


def header_fields(line: str) -> dict[str, str]:
    """The tags of a header line, with its kind under ``@``."""
    kind, *tags = line.rstrip("\r\n").split("\t")
    return {"@": kind} | {k: v for k, _, v in (t.partition(":") for t in tags)}


def require_sorted(header: list[str]) -> None:
    """Refuses a file whose header doesn't say that it is sorted by coordinate. Nothing here needs the order; a run may ask for it."""
    order = next((f.get("SO") for f in map(header_fields, header) if f["@"] == "@HD"), None)
    if order != "coordinate":
        raise ValueError(f"the header says SO:{order}, not SO:coordinate")


def contig_rows(header: list[str]) -> list[tuple[int, str, int]]:
    """(index, name, length) of the header's references, in order."""
    found = [f for f in map(header_fields, header) if f["@"] == "@SQ"]
    return [(k, f["SN"], int(f["LN"])) for k, f in enumerate(found)]


def read_header(spark: SparkSession, path: str) -> list[str]:
    """The header lines of a SAM file, a few for each contig."""
    return [r.value for r in spark.read.text(path).where(F.col("value").rlike("^@(HD|SQ|RG|PG|CO)\t")).collect()]


def read_sam(spark: SparkSession, path: str, check_order: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reads, contigs) of SAM text. Positions are from 0; a missing NH is null; lines of fewer than eleven columns are left out."""
    header = read_header(spark, path)
    if check_order:
        require_sorted(header)
    contigs = spark.createDataFrame(contig_rows(header), CONTIGS)
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").rlike("^@(HD|SQ|RG|PG|CO)\t")).select(parts.alias("c"), "value").where(F.size("c") >= 11)
    names = {"contig": F.when(F.col("c")[2] != "*", F.col("c")[2]), "flag": F.col("c")[1].cast("int"), "pos": F.col("c")[3].cast("int") - 1, "mapq": F.col("c")[4].cast("int"), "cigar": F.col("c")[5]}
    nh = F.nullif(F.regexp_extract("value", "\tNH:i:([0-9]+)", 1), F.lit("")).cast("int")
    rows = lines.select(*(c.alias(n) for n, c in names.items()), nh.alias("nh"))
    placed = rows.join(F.broadcast(contigs.select("contig", "contig_index")), "contig", "left")  # as many rows as the header has contigs
    return placed.select("contig_index", "contig", "pos", "flag", "mapq", "nh", "cigar"), contigs
