"""Schemas of the tables that operators pass on."""

from __future__ import annotations

READS = "contig_index int, contig string, pos int, flag int, mapq int, nh int, cigar string"
CONTIGS = "contig_index int, contig string, length int"
EXONS = "array<struct<start:int,stop:int>>"
GENES = f"gene_uid long, gene_id string, contig string, strand int, start int, stop int, exons {EXONS}"
ANNOTATION = "line_no long, seqname string, source string, feature string, start int, stop int, score string, strand string, frame string, attributes string"
