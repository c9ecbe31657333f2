"""Reads: accounting of rejects, alignments that pass, their blocks and junctions.

Equal alignments are counted once and carried as one row with its number ``n``:
everything after this depends on position, strand and CIGAR only, and the
partial counts meet before any row of a hot position is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.config import Config
from peakweave.functions.alignment import OPERATIONS, reject_reason, splice_of, strand_of


def judged(reads: DataFrame, config: Config) -> DataFrame:
    """``reads`` with ``reject_reason`` (null if it passes) and ``strand``."""
    reason = reject_reason(F.col("flag"), F.col("mapq"), F.col("nh"), config.mapq_min, config.nonunique_alignments)
    return reads.withColumns({"reject_reason": reason, "strand": strand_of(F.col("flag"))})


def reject_summary(reads: DataFrame, config: Config) -> DataFrame:
    """A row per contig: how many reads it has, how many each test rejects, and how many pass on each strand."""
    reason = F.col("reject_reason")
    counts = [F.count_if(reason == name).alias(name) for name in ("duplicate", "unmapped", "multimapped", "low_quality")]
    passing = [F.count_if(reason.isNull() & (F.col("strand") == s)).alias(f"passing_{side}") for s, side in enumerate(("forward", "reverse"))]
    return judged(reads, config).groupBy("contig").agg(F.count(F.lit(1)).alias("total"), *counts, *passing)


def alignments(reads: DataFrame, config: Config) -> DataFrame:
    """``contig, strand, pos, cigar, n`` of the reads that pass; reads without a contig, position or CIGAR operation are left out."""
    passing = judged(reads, config).where("reject_reason IS NULL AND contig IS NOT NULL AND pos IS NOT NULL AND cigar RLIKE '[0-9]+[MIDNSHPX=]'")
    return passing.groupBy("contig", "strand", "pos", "cigar").agg(F.count(F.lit(1)).alias("n"))


def spliced(found: DataFrame) -> DataFrame:
    """``alignments`` with ``points`` and ``junctions`` as positions."""
    ops = F.when(~F.col("cigar").rlike("^[0-9]+M$"), F.expr(OPERATIONS))
    parts = found.withColumn("ops", ops).withColumn("parts", splice_of("cigar", "ops"))
    placed = [F.transform(F.col(f"parts.{c}"), lambda x: x + F.col("pos")).alias(c) for c in ("points", "junctions")]
    return parts.select(*found.columns, *placed)


def _spliced(found: DataFrame) -> DataFrame:
    return found if "points" in found.columns else spliced(found)


def blocks(found: DataFrame) -> DataFrame:
    """A row per block of an alignment, spliced or not: ``block_ix, left, right`` beside the columns of ``alignments``."""
    kept = [c for c in found.columns if c not in ("points", "junctions")]
    pairs = F.transform(F.sequence(F.lit(0), F.expr("size(points) div 2 - 1")), lambda k: F.struct(k.cast("int").alias("block_ix"), F.get("points", 2 * k).alias("left"), F.get("points", 2 * k + 1).alias("right")))
    # outer, or the optimiser infers a filter on the pairs and splices every alignment again for each of them
    return _spliced(found).withColumn("pairs", pairs).select(*kept, F.inline_outer("pairs"))


def junctions(found: DataFrame) -> DataFrame:
    """A row per junction of an alignment: ``junction`` beside the columns of ``alignments``."""
    kept = [c for c in found.columns if c not in ("points", "junctions")]
    return _spliced(found).select(*kept, F.explode_outer("junctions").alias("junction")).where("junction IS NOT NULL")


def contigs(reads: DataFrame) -> DataFrame:
    """The contigs that reads lie on: ``contig_index, contig``."""
    return reads.select("contig_index", "contig").where("contig IS NOT NULL").distinct()
