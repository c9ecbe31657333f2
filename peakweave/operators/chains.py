"""Overlap of transcripts, the one step whose result depends on order.

The functions work on plain lists of (start, stop) intervals: a cluster has a
handful. Spark hands them a row per cluster, or per group of clusters, in Arrow
batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakweave.operators.linking import CLUSTER
from peakweave.sources.shipping import ship

Chain = tuple[tuple[int, int], ...]
MOST_PASSES = 1000


def _meet(x: tuple[int, int], y: tuple[int, int]) -> bool:
    return x[0] <= y[1] and y[0] <= x[1]


def contained(inner: Chain, outer: Chain, epsilon: int | None = None) -> bool:
    """Whether ``inner`` runs along ``outer``: from its first exon that meets one of ``outer`` on, exon pairs meet in step.

    An ``inner`` that is longer still counts when ``outer`` ends. Loosely (with ``epsilon``), any exon also counts at the
    last exon of ``outer`` if the first exon of ``inner`` nearly touches that; strictly, one exon of ``outer`` may take in
    several of ``inner``.
    """
    (start, stop), (last_start, last_stop) = inner[0], outer[-1]
    nearly = epsilon is not None and (abs(last_stop - start) <= epsilon or abs(last_start - stop) <= epsilon)
    at = 0
    while at < len(outer):  # the first exon of outer that inner can begin at
        if _meet(outer[at], inner[0]):
            break
        if nearly and at == len(outer) - 1:
            return True
        at += 1
    else:
        return False
    for k, exon in enumerate(inner):
        if at >= len(outer):
            return True
        if _meet(outer[at], exon):
            spans_next = epsilon is None and k + 1 < len(inner) and inner[k + 1][0] < outer[at][1]
            at += not spans_next
        elif nearly and at == len(outer) - 1:
            at += 1
        else:
            return False
    return True


def merged(a: Chain, b: Chain, epsilon: int) -> Chain:
    """The union of two chains' exons; those that overlap or lie within ``epsilon`` are one."""
    out: list[list[int]] = []
    for start, stop in sorted(a + b):
        if out and start - out[-1][1] <= epsilon:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return tuple((s, e) for s, e in out)


def _family(parent: Chain, children: list[Chain], epsilon: int) -> list[Chain]:
    """The parent merged into each child, and children merged while one contains another."""
    grown: list[Chain | None] = [merged(parent, child, epsilon) for child in children]
    for _ in range(MOST_PASSES):
        settled = True
        for i in range(len(grown)):
            for j in range(i + 1, len(grown)):
                if grown[i] and grown[j] and contained(grown[j], grown[i], epsilon):
                    grown[i], grown[j], settled = merged(grown[i], grown[j], epsilon), None, False
        if settled:
            return [g for g in grown if g]
    raise RuntimeError("a family of transcripts does not settle")


def _pass(chains: list[Chain], epsilon: int) -> tuple[list[Chain], bool]:
    taken: set[int] = set()
    out: list[Chain] = []
    for i, parent in enumerate(chains):
        if i in taken:
            continue
        inside = [j for j in range(i + 1, len(chains)) if chains[j][0][0] <= parent[-1][1] and contained(chains[j], parent, epsilon)]
        taken.update(inside)
        out += _family(parent, [chains[j] for j in inside], epsilon) if inside else [parent]
    return out, not taken


def _turned(chains: list[Chain]) -> list[Chain]:
    return sorted(tuple((-b, -a) for a, b in reversed(chain)) for chain in chains)


def overlapped(chains: list[Chain], counts: list[int], strand: int, epsilon: int) -> tuple[list[Chain], list[int]]:
    """Chains merged until none contains another, in order, with the counts of the inputs that each holds.

    The reverse strand is worked on mirrored. A single result has all counts; of several, each has the counts of the
    inputs that it strictly contains, so that an input may count for more than one, or for none.
    """
    if len(chains) < 2:
        return list(chains), list(counts)
    found = _turned(chains) if strand else list(chains)
    for _ in range(MOST_PASSES):
        found, settled = _pass(found, epsilon)
        if settled:
            break
    else:
        raise RuntimeError("the transcripts of a cluster do not settle")
    found = sorted(_turned(found) if strand else found)
    if len(found) == 1:
        return found, [sum(counts)]
    return found, [sum(n for chain, n in zip(chains, counts, strict=True) if contained(chain, result)) for result in found]


def gap_closed(chain: Chain, junctions: list[int]) -> Chain:
    """Two exons with no junction between them are one."""
    if len(chain) == 2 and not any(chain[0][1] <= j <= chain[1][0] for j in junctions):
        return ((chain[0][0], chain[1][1]),)
    return chain


def folded(members: list[tuple[list[Chain], list[int]]], strand: int, epsilon: int) -> list[tuple[list[Chain], list[int], int]]:
    """Neighbouring clusters' chains taken together from left to right, with how many members each result is made of."""
    out: list[tuple[list[Chain], list[int], int]] = []
    for chains, counts in members:
        if out and max(c[-1][1] for c in out[-1][0]) >= chains[0][0][0]:
            before, had, n = out[-1]
            out[-1] = (*overlapped(before + chains, had + counts, strand, epsilon), n + 1)
        else:
            out.append((chains, counts, 1))
    return out


_CHAINS = "array<array<struct<start:int,stop:int>>>"


def _plain(chains: list) -> list[Chain]:
    return [tuple((e["start"], e["stop"]) for e in chain) for chain in chains]


def _nested(rows: list[list[Chain]]) -> pa.Array:
    exon = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    return pa.array([[[{"start": a, "stop": b} for a, b in chain] for chain in row] for row in rows], pa.list_(pa.list_(exon)))


def overlap_clusters(paths: DataFrame, junctions: DataFrame, epsilon: int) -> DataFrame:
    """A row per cluster with paths: ``chains, counts`` after overlap and gap closing. paths: ``five, three, n, exons``."""
    ship(paths.sparkSession)
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("five", F.lit(-1)).alias("five"), F.coalesce("three", F.lit(-1)).alias("three"), "exons", "n")))
    gathered = paths.groupBy(*CLUSTER).agg(ordered.alias("_p")).select(*CLUSTER, F.col("_p.exons").alias("chains"), F.col("_p.n").alias("counts"))
    crossed = junctions.groupBy(*CLUSTER).agg(F.collect_set("junction").alias("junctions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chains, counts = [], []
            for row in batch.select(["strand", "chains", "counts", "junctions"]).to_pylist():
                found, n = overlapped(_plain(row["chains"]), row["counts"], row["strand"], epsilon)
                chains.append([gap_closed(c, row["junctions"] or []) for c in found])
                counts.append(n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in CLUSTER), _nested(chains), pa.array(counts, pa.list_(pa.int64()))], [*CLUSTER, "chains", "counts"])

    return gathered.join(crossed, CLUSTER, "left").mapInArrow(run, f"contig string, strand int, cluster int, chains {_CHAINS}, counts array<long>")


def collapse_clusters(found: DataFrame, sizes: DataFrame, epsilon: int) -> DataFrame:
    """Clusters whose transcripts overlap those of the next one, taken together.

    Gives ``contig, strand, cluster`` (the first one's), ``stop, read_count, chains, counts``. found: of overlap_clusters;
    sizes: ``cluster, stop, read_count``. Clusters without transcripts neither join nor part their neighbours.
    """
    ship(found.sparkSession)
    first, last = F.expr("chains[0][0].start"), F.expr("array_max(transform(chains, c -> element_at(c, -1).stop))")
    along = W.partitionBy("contig", "strand").orderBy("cluster")
    reach = F.max("_last").over(along.rowsBetween(W.unboundedPreceding, -1))
    marked = found.join(sizes.select(*CLUSTER, "stop", "read_count"), CLUSTER).withColumn("_first", first).withColumn("_last", last)
    marked = marked.withColumn("_new", F.when(reach.isNull() | (reach < F.col("_first")), F.col("cluster")))
    marked = marked.withColumn("_group", F.max("_new").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = F.array_sort(F.collect_list(F.struct("cluster", "stop", "read_count", "chains", "counts")))
    gathered = marked.groupBy("contig", "strand", "_group").agg(rows.alias("members")).select("contig", "strand", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                at = 0
                members = row["members"]
                for chains, counts, n in folded([(_plain(m["chains"]), m["counts"]) for m in members], row["strand"], epsilon):
                    own = members[at : at + n]
                    at += n
                    out.append((row["contig"], row["strand"], own[0]["cluster"], own[-1]["stop"], sum(m["read_count"] for m in own), chains, counts))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            plain = [pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([*plain, _nested(list(columns[5])), pa.array(columns[6], pa.list_(pa.int64()))], ["contig", "strand", "cluster", "stop", "read_count", "chains", "counts"])

    return gathered.mapInArrow(run, f"contig string, strand int, cluster int, stop int, read_count long, chains {_CHAINS}, counts array<long>")


def transcripts(collapsed: DataFrame) -> DataFrame:
    """A row per transcript: ``tx_ix, exons, core_points, counts``, the reads of its cluster dealt by core points."""
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    each = collapsed.withColumn("total", total).select("contig", "strand", "cluster", "stop", "read_count", "total", F.posexplode(F.arrays_zip("chains", "counts")).alias("tx_ix", "_t"))
    share = F.coalesce(F.try_divide(F.col("_t.counts").cast("double"), F.col("total")) * F.col("read_count"), F.lit(0.0))
    return each.select("contig", "strand", "cluster", "stop", "read_count", "tx_ix", F.col("_t.chains").alias("exons"), F.col("_t.counts").alias("core_points"), share.alias("counts"))
