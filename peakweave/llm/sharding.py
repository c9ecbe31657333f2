"""Minimax contiguous partition of atomic groups into shards of near-equal bytes.

Documents of equal text are one atomic group. Groups stand in the order of a
digest of their text; the shards are contiguous runs of that order, and the
largest shard is as small as contiguous runs allow. The smallest feasible
capacity is found by binary search, checked greedily, then the runs are cut.

The driver never sees the groups. It holds a histogram of digest prefixes, and
refines only the prefixes in which a cut can still fall: bounds on the capacity
come from treating an unrefined prefix as fluid (lower) or as atomic (upper).
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.llm._shared import materialise

SHARDS, FIRST_DIGITS, MORE_DIGITS, SLOT_BLOCKS, BLOCK_ROWS = 8, 3, 2, 512, 1_000_000

#: A prefix of the digest, the bytes of its groups, their number, the bytes of the largest.
Segment = tuple[str, int, int, int]


def _greedy(ends: list[int], capacity: int, shards: int, fluid: list[bool]) -> list[tuple[int, int]] | None:
    """Where each shard ends, as (segment index, bytes before), if so many shards of this capacity hold everything."""
    done, cuts = 0, []
    for _ in range(shards):
        aim = done + capacity
        k = bisect_right(ends, aim)
        if k == len(ends):
            cuts.append((k, ends[-1]))
            return cuts
        done = aim if fluid[k] else (ends[k - 1] if k else 0)
        cuts.append((k, done))
    return None


def _smallest(segments: list[Segment], shards: int, fluid: list[bool]) -> int:
    ends = list(accumulate(s[1] for s in segments))
    low, high = max(-(-ends[-1] // shards), max(s[3] for s in segments)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if _greedy(ends, middle, shards, fluid):
            high = middle
        else:
            low = middle + 1
    return low


def _cuts(segments: list[Segment], capacity: int, shards: int, fluid: list[bool]) -> list[int]:
    found = _greedy(list(accumulate(s[1] for s in segments)), capacity, shards, fluid) or []
    return [k for k, _ in found] + [len(segments)] * (shards - len(found))


def boundaries(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity, and the digest prefix at which each shard but the first begins. groups: ``digest, bytes``."""

    def histogram(where: DataFrame, digits: int) -> list[Segment]:
        prefix = F.substring("digest", 1, digits).alias("p")
        return [tuple(r) for r in where.groupBy(prefix).agg(F.sum("bytes"), F.count(F.lit(1)), F.max("bytes")).collect()]

    digits = FIRST_DIGITS
    segments = sorted(histogram(groups, digits))
    if not segments:
        return 0, []
    while True:
        open_ = [s[2] > 1 for s in segments]
        low, high = _smallest(segments, shards, open_), _smallest(segments, shards, [False] * len(segments))
        first, last = _cuts(segments, low, shards, [False] * len(segments)), _cuts(segments, high, shards, open_)
        wanted = [i for a, b in zip(first, last, strict=True) for i in range(min(a, b), min(max(a, b) + 1, len(segments))) if open_[i]]
        if not wanted:
            break
        refined, digits = {segments[i][0] for i in wanted}, digits + MORE_DIGITS
        inside = F.lit(False)
        for n in sorted({len(p) for p in refined}):
            inside |= F.substring("digest", 1, n).isin([p for p in refined if len(p) == n])
        finer = histogram(groups.where(inside), digits)
        segments = sorted([s for s in segments if s[0] not in refined] + finer)
    atomic = [False] * len(segments)
    capacity = _smallest(segments, shards, atomic)
    starts = [k for k in _cuts(segments, capacity, shards, atomic)[: shards - 1] if k < len(segments)]
    return capacity, [segments[k][0] for k in starts]


def minimax_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    size is the text's UTF-8 bytes plus one; a null text counts as empty and shares the empty texts' group. Equal texts,
    repeated rows included, lie in one shard, so a shard can outgrow its fair share by one group and no more. Slots are
    gapless from 0 in each shard. An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.substring(F.sha2(text, 256), 1, 40).alias("digest"), F.monotonically_increasing_id().alias("place"))
    rows = materialise(plain, "sizes")
    groups = materialise(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    _, starts = boundaries(groups, shards)
    shard = F.lit(0)
    for start in starts:
        shard += (F.col("digest") >= start).cast("int")
    blocks = max(SLOT_BLOCKS, rows.count() // BLOCK_ROWS)  # its files know the count
    placed = rows.withColumn("shard", shard).withColumn("_block", F.pmod(F.xxhash64("doc_id", "digest", "place"), F.lit(blocks)).cast("int"))  # repeated rows go to many blocks
    counts = placed.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = "coalesce(sum(_n) over (partition by shard order by _block rows between unbounded preceding and 1 preceding), 0)"
    offsets = counts.select("shard", "_block", F.expr(before).alias("_before"))  # a row per shard and block: of a fixed size
    within = F.expr("row_number() over (partition by shard, _block order by doc_id, digest, place)")
    numbered = placed.withColumn("_at", within).join(F.broadcast(offsets), ["shard", "_block"])
    slot = (F.col("_before") + F.col("_at") - 1).cast("long")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
