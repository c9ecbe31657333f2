"""Bucketed comparison in bounded memory.

Rows that share a bucket are compared with one another. A bucket of more than
``chunk`` rows is cut into chunks, and each pair of chunks is a tile of its own,
so that no task ever holds more than two chunks of a bucket, however hot it is.
Tiles reach Python sorted, and are read run by run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakweave.llm._shared import fits, mapped, materialise

CHUNK = 1024
#: A table of hot buckets of at most so many rows is broadcast.
BROADCAST_ROWS = 100_000


def tiled(rows: DataFrame, bucket: list[str], item: str, chunk: int = CHUNK, worth: Column | None = None, prune: bool = True) -> DataFrame:
    """``rows`` with ``tile`` (long, equal for rows to compare) and ``side`` (0, 1; 2 if the tile is one chunk).

    Buckets of a single row are left out, and those for which the aggregate ``worth`` is false; without ``prune`` they stay,
    which saves a shuffle where they are few. Rows of a bucket of more than a chunk are found through a table of such
    buckets, of which there are at most a chunk's share of the rows, and never meet in one task. ``rows`` should be cheap to read twice.
    """
    sizes = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"), (worth if worth is not None else F.lit(True)).alias("_worth"))
    hot = materialise(sizes.where((F.col("_n") > chunk) & F.col("_worth")).drop("_worth"), "hot-buckets")
    hot = F.broadcast(hot) if fits(hot, BROADCAST_ROWS) else hot
    large = rows.join(hot, bucket).withColumn("_parts", F.ceil(F.col("_n") / chunk).cast("int")).drop("_n")
    large = large.withColumn("_own", F.pmod(F.xxhash64(item, F.lit(7)), F.col("_parts")).cast("int"))
    large = large.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(low == high, 2).when(F.col("_own") == low, 0).otherwise(1)
    large = large.select(*rows.columns, F.xxhash64(*bucket, low, high).alias("tile"), side.alias("side"))
    small = rows.join(hot.drop("_n"), bucket, "left_anti")
    if prune:
        small = small.join(sizes.where((F.col("_n") > 1) & (F.col("_n") <= chunk) & F.col("_worth")).drop("_n", "_worth"), bucket)
    return large.unionByName(small.select(*rows.columns, F.xxhash64(*bucket).alias("tile"), F.lit(2).alias("side")))


def map_tiles(rows: DataFrame, work: Callable[[pa.Table], pa.Table | None], schema: str, order: list[str]) -> DataFrame:
    """Runs ``work`` over tables that hold whole tiles, each tile's rows together (many small tiles, or one large one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = batch.column("tile").to_numpy()
            last = int(np.searchsorted(tile, tile[-1]))  # sorted, so this is where its last tile begins
            if kept and last:
                head = pa.Table.from_batches([*kept, batch.slice(0, last)])
                kept = [batch.slice(last)]
            elif kept and kept[-1].column("tile")[-1].as_py() != int(tile[0]):
                head, kept = pa.Table.from_batches(kept), [batch]
            elif last:
                head, kept = pa.Table.from_batches([batch.slice(0, last)]), [batch.slice(last)]
            else:
                kept.append(batch)
                continue
            if (out := work(head)) is not None:
                yield from out.to_batches()
        if kept and (out := work(pa.Table.from_batches(kept))) is not None:
            yield from out.to_batches()

    return mapped(rows.repartition("tile").sortWithinPartitions("tile", *order), run, schema)


def runs(tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each tile begins, and its length."""
    starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    return starts, np.diff(np.r_[starts, len(tile)])


def stars(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A boolean matrix of links as stars: (root, other) for each row that reaches another, with the same components."""
    left, roots, others = np.ones(len(linked), bool), [], []
    for i in range(len(linked)):
        if not left[i]:
            continue
        left[i] = False
        front = np.array([i])
        while len(front):
            new = linked[front].any(axis=0) & left
            left &= ~new
            front = np.flatnonzero(new)
            roots.append(np.full(len(front), i))
            others.append(front)
    return (np.concatenate(roots), np.concatenate(others)) if roots else (np.empty(0, int), np.empty(0, int))
