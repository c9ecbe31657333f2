"""Settings of a run, passed explicitly to whatever needs them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """What a run can be told; the defaults are those of the command line."""

    annotation: str = ""
    strandedness: str = "forward"
    nonunique_alignments: bool = False
    mapq_min: int = 1
    window_size: int = 1000
    min_count: int = 25
    count_percentage: int = 5
    epsilon: int = 50
    density_threshold: float = 0.0
    feature_tag: str = "exon"
    utr_tag: str = "UTR"
    feature_id: str = "gene_id"
    output_gtf: str = ""
    prefix: str = "Peak"
    #: Match an attribute by a key that merely contains ``feature_id``.
    loose_feature_id: bool = False
    #: Count genes at the best score, not hits, when a read's best match is judged.
    count_distinct_genes: bool = False

    def __post_init__(self) -> None:
        if self.strandedness not in ("forward", "reverse"):
            raise ValueError("strandedness is forward or reverse")
        if self.window_size < 0 or self.epsilon < 0:
            raise ValueError("window_size and epsilon are not negative")

    @property
    def least_reads(self) -> int:
        """Clusters of fewer reads are not searched for transcripts, whatever min_count says."""
        return max(self.min_count, 10)


#: A path of fewer points than this supports no transcript, and no point is a core with fewer neighbours.
LEAST_SUPPORT = 10
