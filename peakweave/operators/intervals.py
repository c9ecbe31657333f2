"""Operators on positions and intervals, for any domain: both ends of an interval belong to it.

Long keys are cut into bins of positions, so that a key that holds a third of
the rows is still spread over many tasks; what crosses a bin's edge is settled
from one summary row per bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BIN = 1 << 20
JOIN_BIN = 1 << 14


def _bin(pos: Column | str, width: int) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(width)).cast("long")


def gap_islands(points: DataFrame, keys: Sequence[str], pos: str, gap: int, bin_width: int = BIN) -> DataFrame:
    """``points`` with ``island``: the first position of the run in which no two neighbours are more than ``gap`` apart.

    Points may repeat. Positions must not be null. Points are shuffled once: the summary of bins and the join with it
    use the partitioning of the window.
    """
    per_bin = [*keys, "_bin"]
    along = W.partitionBy(*keys).orderBy("_bin")
    inside = W.partitionBy(*per_bin).orderBy(pos)
    binned = points.withColumn("_bin", _bin(pos, bin_width))
    marked = binned.withColumn("_start", F.when(F.col(pos) - F.lag(pos).over(inside) > gap, F.col(pos)))
    bins = marked.groupBy(*per_bin).agg(F.min(pos).alias("_low"), F.max(pos).alias("_high"), F.max("_start").alias("_latest"))
    fresh = F.col("_before").isNull() | (F.col("_low") - F.col("_before") > gap)
    bins = bins.withColumn("_before", F.lag("_high").over(along)).withColumn("_fresh", F.when(fresh, F.col("_low")))
    carried = F.max(F.coalesce("_latest", "_fresh")).over(along.rowsBetween(W.unboundedPreceding, -1))
    bins = bins.select(*per_bin, F.coalesce("_fresh", carried).alias("_head"))  # the island that a bin begins in
    own = F.max("_start").over(inside.rangeBetween(W.unboundedPreceding, W.currentRow))
    return marked.withColumn("_own", own).join(bins, per_bin).withColumn("island", F.coalesce("_own", "_head")).select(*points.columns, "island")


def interval_union(intervals: DataFrame, keys: Sequence[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """The union of each key's intervals, ``keys, start, stop``: those that share a position are joined, neighbours are not."""
    order = W.partitionBy(*keys).orderBy(start, stop)
    reach = F.max(stop).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = intervals.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    run = F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return marked.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(start).alias("start"), F.max(stop).alias("stop")).drop("_run")


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], bin_width: int = JOIN_BIN) -> DataFrame:
    """Pairs of rows with equal keys and overlapping spans; no other column name may be on both sides.

    Each interval is filed under the bins that it touches, and a pair is kept in the bin where its overlap begins, so the
    join is an equality join that spreads a key over its bins and gives each pair once.
    """
    (l0, l1), (r0, r1) = left_span, right_span

    def filed(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.where(F.col(a) <= F.col(b)).withColumn("_bin", F.explode(F.sequence(_bin(a, bin_width), _bin(b, bin_width))))

    pairs = filed(left, l0, l1).join(filed(right, r0, r1), [*keys, "_bin"])
    meet = (F.col(l0) <= F.col(r1)) & (F.col(r0) <= F.col(l1)) & (_bin(F.greatest(l0, r0), bin_width) == F.col("_bin"))
    return pairs.where(meet).drop("_bin")


def unique_argmax(scores: DataFrame, keys: Sequence[str], score: str, value: str, row: Sequence[str] = ()) -> DataFrame:
    """For each key ``status, best, value``: assigned if one row has the best score, ambiguous if several, unassigned if it is 0.

    Rows are told apart by ``value`` and the columns ``row``; of rows that agree in them only the best counts. It is one
    aggregation: the best score is held by one row if the first and the last of those that hold it are the same.
    """
    held = F.struct(*row, F.col(value).alias("_value"))
    ends = scores.groupBy(*keys).agg(F.max(F.struct(F.col(score).alias("s"), held.alias("r"))).alias("_last"), F.min(F.struct((-F.col(score)).alias("s"), held.alias("r"))).alias("_first"))
    best, one = F.col("_last.s"), F.col("_last.r").eqNullSafe(F.col("_first.r"))
    status = F.when(best <= 0, "unassigned").when(one, "assigned").otherwise("ambiguous")
    return ends.select(*keys, status.alias("status"), best.alias("best"), F.when(one & (best > 0), F.col("_last.r._value")).alias("value"))


def ratio_allocate(df: DataFrame, keys: Sequence[str], part: str, total: str, out: str = "share") -> DataFrame:
    """``total`` dealt to the rows of a key in proportion to ``part``; 0 where the parts add up to nothing."""
    share = F.try_divide(F.col(part).cast("double"), F.sum(part).over(W.partitionBy(*keys)))
    return df.withColumn(out, F.coalesce(share * F.col(total), F.lit(0.0)))


def ordered_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "run") -> DataFrame:
    """``df`` with the number of the run of equal, consecutive ``value`` that a row is in, from 1."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_new")


def first_ending_at_or_after(points: DataFrame, intervals: DataFrame, keys: Sequence[str], pos: str, value: str, start: str = "start", stop: str = "stop", bin_width: int = BIN) -> DataFrame:
    """``points`` with ``nearest``: the value of the first interval, by start then stop then value, that ends at or after the point; null if none does.

    Points and interval ends of a bin are merged in one descending scan; the first interval of all later bins is carried in.
    """
    first = F.struct(F.col(start).alias("a"), F.col(stop).alias("b"), F.col(value).alias("v"))
    marks = intervals.select(*keys, F.col(stop).alias("_at"), F.lit(0).alias("_kind"), first.alias("_first"))
    asked = points.select(*keys, F.col(pos).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_first"].dataType).alias("_first")).distinct()
    both = marks.unionByName(asked).withColumn("_bin", _bin("_at", bin_width))
    within = W.partitionBy(*keys, "_bin").orderBy(F.desc("_at"), "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    later = W.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(W.unboundedPreceding, -1)
    carried = both.groupBy(*keys, "_bin").agg(F.min("_first").alias("_least")).withColumn("_later", F.min("_least").over(later)).drop("_least")
    seen = both.withColumn("_first", F.min("_first").over(within)).where("_kind = 1").join(carried, [*keys, "_bin"])
    answers = seen.select(*keys, F.col("_at").alias(pos), F.least("_first", "_later")["v"].alias("nearest"))
    return points.join(answers, [*keys, pos], "left")
