"""Column functions on alignments: why a read is rejected, its strand, and the blocks and junctions of its CIGAR."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DUPLICATE, UNMAPPED, SECONDARY, REVERSE = 1024, 4, 256, 16


def _has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def reject_reason(flag: Column, mapq: Column, nh: Column, mapq_min: int = 1, nonunique: bool = False) -> Column:
    """The first test that a read fails: duplicate, unmapped, multimapped or low_quality; null if it passes.

    A missing NH counts as one hit. QC-fail, supplementary and mate flags are not looked at.
    """
    several = (F.coalesce(nh, F.lit(1)) > 1) | _has(flag, SECONDARY)
    reason = F.when(_has(flag, DUPLICATE), "duplicate").when(_has(flag, UNMAPPED), "unmapped")
    if not nonunique:
        reason = reason.when(several, "multimapped")
    return reason.when(mapq < mapq_min, "low_quality")


def strand_of(flag: Column) -> Column:
    """0 forward, 1 reverse."""
    return _has(flag, REVERSE).cast("int")


#: An operation list of a CIGAR: ``array<struct<n:int,op:string>>``.
OPERATIONS = "transform(regexp_extract_all(cigar, '[0-9]+[MIDNSHPX=]', 0), o -> named_struct('n', cast(left(o, length(o) - 1) as int), 'op', right(o, 1)))"


def splice(ops: str) -> Column:
    """Offsets of an operation list: a struct of ``points`` (left, right, left, right, ... of its blocks) and ``junctions``.

    Only M and N move. A block ends where an M after an N is followed by another operation, unless that one is the last
    but one and an insertion or deletion; so a read with one gap is one block across it. ``ops`` must not be empty.
    """
    n, op = f"{ops}[i].n", f"{ops}[i].op"
    state = "named_struct('cur', {0}, 'gap', {1}, 'points', {2}, 'junctions', {3})"
    begin = state.format("0", "0", "array(0)", "cast(array() as array<int>)")
    move = state.format(f"s.cur + {n}", "s.gap", "s.points", "s.junctions")
    skip = state.format(f"s.cur + {n}", n, "s.points", "array_append(s.junctions, s.cur + 1)")
    end = state.format(f"s.cur + {n}", "0", f"concat(s.points, array(s.cur + {n} - 1, s.cur))", "s.junctions")
    ends = f"s.gap <> 0 and i <> size({ops}) - 1 and not ({ops}[i + 1].op in ('I', 'D') and i + 2 = size({ops}) - 1)"
    step = f"case when {op} = 'N' then {skip} when {op} = 'M' and {ends} then {end} when {op} = 'M' then {move} else s end"
    finish = "s -> named_struct('points', array_append(s.points, s.cur - 1), 'junctions', s.junctions)"
    return F.expr(f"aggregate(sequence(0, size({ops}) - 1), {begin}, (s, i) -> {step}, {finish})")


def splice_of(cigar: str, ops: str) -> Column:
    """``splice``, but for a CIGAR of one match, as most are, without walking its operations."""
    plain = f"named_struct('points', array(0, cast(left({cigar}, length({cigar}) - 1) as int) - 1), 'junctions', cast(array() as array<int>))"
    return F.when(F.col(cigar).rlike("^[0-9]+M$"), F.expr(plain)).otherwise(splice(ops))


def mirrored(intervals: Column) -> Column:
    """A list of intervals seen from the other end: negated, start and stop swapped, in reverse order."""
    return F.transform(F.reverse(intervals), lambda x: F.struct((-x["stop"]).alias("start"), (-x["start"]).alias("stop")))
