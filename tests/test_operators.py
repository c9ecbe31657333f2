"""Golden values and randomised models of the peak and interval operators."""

import random

import pytest
from pyspark.sql import functions as F

from peakweave.config import Config
from peakweave.operators import assign, chains, density, genes, intervals, linking, reads, sessions
from peakweave.plans import pipeline
from peakweave.sources import annotation, sinks

READS = "contig_index int, contig string, pos int, flag int, mapq int, nh int, cigar string"


def _reads(spark, rows):
    return spark.createDataFrame([(0, "chr1", pos, flag, mapq, nh, cigar) for pos, flag, mapq, nh, cigar in rows], READS)


def test_rejects_are_counted_by_the_first_test_that_fails(spark):
    rows = [(0, 0, 9, 1, "9M"), (0, 1024, 0, 2, "9M"), (0, 4, 0, 2, "9M"), (0, 0, 0, 2, "9M"), (0, 256, 9, None, "9M"), (0, 0, 0, None, "9M"), (0, 16, 9, None, "9M"), (0, 0x800 | 0x200, 9, 1, "9M")]
    got = reads.reject_summary(_reads(spark, rows), Config()).first().asDict()
    assert got == {"contig": "chr1", "total": 8, "duplicate": 1, "unmapped": 1, "multimapped": 2, "low_quality": 1, "passing_forward": 2, "passing_reverse": 1}
    loose = reads.reject_summary(_reads(spark, rows), Config(nonunique_alignments=True)).first()
    assert (loose.multimapped, loose.low_quality, loose.passing_forward) == (0, 2, 3)


SPLICED = {
    "100M": ([(0, 99)], []),
    "50M100N50M": ([(0, 199)], [51]),
    "10M30N30M10N30M": ([(0, 69), (40, 109)], [11, 71]),
    "50M100N40M10S": ([(0, 189), (150, 189)], [51]),
    "10S40M": ([(0, 39)], []),
    "40M5D40M": ([(0, 79)], []),
    "40M5I40M": ([(0, 79)], []),
    "40M10N20M5D20M": ([(0, 89)], [41]),
    "40M10N20M5I10M10N10M": ([(0, 69), (50, 99)], [41, 81]),
    "50M100N20=": ([(0, 149)], [51]),
    "*": ([], []),
    "": ([], []),
}


def test_splice(spark):
    found = reads.alignments(_reads(spark, [(7, 0, 9, 1, c) for c in SPLICED]), Config())
    blocks, crossed = {}, {}
    for r in reads.blocks(found).orderBy("cigar", "block_ix").collect():
        blocks.setdefault(r.cigar, []).append((r.left - 7, r.right - 7))
    for r in reads.junctions(found).orderBy("junction").collect():
        crossed.setdefault(r.cigar, []).append(r.junction - 7)
    assert blocks == {c: b for c, (b, _) in SPLICED.items() if b}
    assert crossed == {c: j for c, (_, j) in SPLICED.items() if j}


def _windows(positions, w):
    """The greedy windows and their collapse, one read after another."""
    opened = []
    for p in sorted(positions):
        if opened and p <= opened[-1][1]:
            opened[-1][2] += 1
        else:
            opened.append([p, p + w, 1])
    out = []
    for start, stop, n in opened:
        if out and start - out[-1][1] <= w:
            out[-1] = (out[-1][0], stop, out[-1][2] + n)
        else:
            out.append((start, stop, n))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_the_greedy_model(spark, seed):
    rng, w = random.Random(seed), 50
    places = {(c, s): [rng.randrange(3000) for _ in range(rng.randrange(5, 80))] for c in ("a", "b", "c") for s in (0, 1)}
    rows = [(c, s, p, "9M", 1) for (c, s), ps in places.items() for p in ps]
    found = spark.createDataFrame(rows, "contig string, strand int, pos int, cigar string, n long").groupBy("contig", "strand", "pos", "cigar").agg(F.sum("n").alias("n"))
    islands = sessions.anchored_islands(found, w)
    got = {}
    for r in sessions.clusters(islands, w).orderBy("cluster").collect():
        got.setdefault((r.contig, r.strand), []).append((r.start, r.stop, r.read_count))
    assert got == {k: _windows(ps, w) for k, ps in places.items()}


def test_islands_do_not_depend_on_bins(spark):
    rng = random.Random(4)
    points = spark.createDataFrame([(k, rng.randrange(5000)) for k in ("x", "y") for _ in range(300)], "k string, pos int")
    wide, narrow = (sorted(map(tuple, intervals.gap_islands(points, ["k"], "pos", 20, width).collect())) for width in (1 << 20, 16))
    want, last = [], {}
    for k, p in sorted(map(tuple, points.collect())):
        island = last[k][1] if k in last and p - last[k][0] <= 20 else p
        last[k] = (p, island)
        want.append((k, p, island))
    assert wide == narrow == want


def _dbscan(points, eps, least):
    """Labels by plain expansion: cores, chains of cores, then the points beside them, left first."""
    points = sorted(points)
    cores = [p for p in points if sum(abs(p - q) <= eps for q in points) - 1 >= least]
    label, last = {}, None
    for p in sorted(set(cores)):
        label[p] = 0 if last is None else label[last] + (p - last > eps)
        last = p
    out = {}
    for p in set(points):
        left, right = max((c for c in label if c <= p), default=None), min((c for c in label if c >= p), default=None)
        out[p] = label[left] if left is not None and p - left <= eps else label[right] if right is not None and right - p <= eps else None
    return out


@pytest.mark.parametrize("seed", range(3))
def test_dbscan_equals_plain_expansion(spark, seed):
    rng = random.Random(seed)
    sets = {k: [rng.choice((0, 150, 400)) + rng.randrange(90) for _ in range(60)] for k in range(6)}
    df = spark.createDataFrame([(k, p, 12) for k, ps in sets.items() for p in ps], "k int, pos int, least int").groupBy("k", "pos", "least").agg(F.count("*").alias("n"))
    got = {}
    for r in density.dbscan_1d(df, ["k"], 9, "least").collect():
        got.setdefault(r.k, {})[r.pos] = r.label
    assert got == {k: _dbscan(ps, 9, 12) for k, ps in sets.items()}


def test_least_neighbours_is_cut_not_rounded(spark):
    got = [r[0] for r in spark.createDataFrame([(100,), (10,)], "n long").select(density.least_neighbours(F.col("n"), 29)).collect()]
    assert got == [28, 10]  # 100 * 0.29 is a little less than 29


def _paths(spark, pairs):
    rows, names = [], {}
    for (five, three), n in pairs.items():
        rows.append(("c", 0, 0, (five if five is not None else 99) * 10, 1000 + (three if three is not None else 99) * 10, n))
        names[five], names[three] = 1, 1
    blocks = spark.createDataFrame(rows, "contig string, strand int, cluster int, left int, right int, n long")
    label = "contig string, strand int, cluster int, pos int, label int"
    left = spark.createDataFrame([("c", 0, 0, (f if f is not None else 99) * 10, f) for f in {p[0] for p in pairs}], label)
    right = spark.createDataFrame([("c", 0, 0, 1000 + (t if t is not None else 99) * 10, t) for t in {p[1] for p in pairs}], label)
    return linking.paths(blocks, left, right)


def test_orphans_are_absorbed_before_small_paths_go(spark):
    pairs = {(None, None): 2, (0, None): 5, (0, 0): 26, (1, None): 1, (1, 1): 23, (2, None): 10, (2, 1): 10}
    got = {(r.five, r.three): r.n for r in _paths(spark, pairs).collect()}
    assert got == {(0, 0): 26, (1, 1): 23, (2, 1): 10}
    assert {(r.five, r.three): r.n for r in _paths(spark, {(1, 1): 12, (1, 10): 12}).collect()} == {(1, 1): 12, (1, 10): 12}


def _regions(spark, rows):
    return spark.createDataFrame([("c", 0, 0, *r) for r in rows], "contig string, strand int, cluster int, label int, lo int, hi int")


def test_coordinates(spark):
    paths = _paths(spark, {(1, 1): 12, (1, 10): 12})
    got = linking.coordinates(paths, _regions(spark, [(1, 1000, 1100)]), _regions(spark, [(1, 5000, 5100), (10, 8000, 8100)]), 150)
    assert sorted([tuple(e) for e in r.exons] for r in got.collect()) == [[(1000, 1100), (5000, 5100)], [(1000, 1100), (8000, 8100)]]
    nested = linking.coordinates(_paths(spark, {(1, 1): 12}), _regions(spark, [(1, 100, 291)]), _regions(spark, [(1, 150, 284)]), 150)
    assert [tuple(e) for e in nested.first().exons] == [(100, 284)]  # the later region's end, although it is nested


def test_chain_overlap_golden():
    found = [((4959707, 4959824), (4960962, 4961018)), ((4960962, 4961094), (4962137, 4962291)), ((4962137, 4962284),)]
    assert chains.overlapped(found, [26, 23, 10], 0, 150) == ([((4959707, 4959824), (4960962, 4961094), (4962137, 4962291))], [59])


def _runs_along(inner, outer, eps=None):
    """Containment said at once: the place where inner begins, then every pair in step."""
    meet = lambda x, y: max(x[0], y[0]) <= min(x[1], y[1])
    close = eps is not None and min(abs(outer[-1][1] - inner[0][0]), abs(outer[-1][0] - inner[0][1])) <= eps
    last = len(outer) - 1
    begins = [k for k, exon in enumerate(outer) if meet(exon, inner[0]) or (close and k == last)]
    if not begins:
        return False
    if eps is None:
        at = begins[0]
        for k, exon in enumerate(inner):
            if at > last:
                break
            if not meet(outer[at], exon):
                return False
            at += not (k + 1 < len(inner) and inner[k + 1][0] < outer[at][1])
        return True
    return all(meet(x, y) or (close and k == last) for k, (x, y) in enumerate(zip(outer[begins[0] :], inner, strict=False), begins[0]))


def _joined(chains_, eps):
    """Exons as painted positions, gaps of up to eps painted too."""
    painted = sorted({2 * p + half for c in chains_ for a, b in c for p in range(a, b + 1) for half in ((0, 1) if p < b else (0,))})
    out = []
    for p in painted:
        if out and p - out[-1][1] <= max(1, 2 * eps):
            out[-1][1] = p
        else:
            out.append([p, p])
    return tuple((a // 2, b // 2) for a, b in out)


def _settled(chains_, counts, strand, eps):
    """Families one round after another, until a round takes nothing in."""
    flip = lambda cs: sorted(tuple(sorted((-b, -a) for a, b in c)) for c in cs)
    if len(chains_) < 2:
        return list(chains_), list(counts)
    found, changed = flip(chains_) if strand else list(chains_), True
    while changed:
        out, children, changed = [], set(), False
        for i, parent in enumerate(found):
            inside = {j for j in range(i + 1, len(found)) if found[j][0][0] <= parent[-1][1] and _runs_along(found[j], parent, eps)} if i not in children else None
            if not inside:
                out += [parent] if inside is not None else []
                continue
            children |= inside  # a child may have several parents, but is none itself
            changed, family, again = True, [_joined([parent, found[j]], eps) for j in sorted(inside)], True
            while again:
                again = False
                for i in range(len(family)):
                    for j in range(i + 1, len(family)):
                        if family[i] and family[j] and _runs_along(family[j], family[i], eps):
                            family[i], family[j], again = _joined([family[i], family[j]], eps), (), True
            out += [c for c in family if c]
        found = out
    found = sorted(flip(found) if strand else found)
    if len(found) == 1:
        return found, [sum(counts)]
    return found, [sum(n for c, n in zip(chains_, counts, strict=True) if _runs_along(c, r)) for r in found]


def _random_chain(rng):
    at, out = rng.randrange(0, 500), []
    for _ in range(rng.choice((1, 1, 2, 2, 3))):
        out.append((at, at + rng.randrange(1, 160)))
        at = out[-1][1] + rng.randrange(1, 220)
    return tuple(out)


def test_containment_equals_its_statement():
    assert not chains.contained(((0, 100), (320, 400)), ((0, 100), (200, 300)), 50)  # the first exon is what must nearly touch
    assert chains.contained(((340, 400),), ((0, 100), (200, 300)), 50) and not chains.contained(((351, 400),), ((0, 100), (200, 300)), 50)
    assert chains.contained(((10, 20), (30, 40), (250, 260)), ((0, 100), (200, 300))) and not chains.contained(((10, 20), (110, 120)), ((0, 100), (200, 300)))
    rng = random.Random(21)
    for _ in range(20_000):
        a, b = _random_chain(rng), _random_chain(rng)
        for eps in (None, 0, 50):
            assert chains.contained(a, b, eps) == _runs_along(a, b, eps), (a, b, eps)


@pytest.mark.parametrize("strand", [0, 1])
def test_overlap_equals_its_model(strand):
    rng, several = random.Random(30 + strand), 0
    for _ in range(600):
        found = sorted({_random_chain(rng) for _ in range(rng.randrange(1, 7))})
        counts = [rng.randrange(10, 50) for _ in found]
        got = chains.overlapped(found, counts, strand, 50)
        assert got == _settled(found, counts, strand, 50), found
        several += len(got[0]) > 1
    assert several > 100


@pytest.mark.parametrize("strand", [0, 1])
def test_chains_settle_and_cover_their_inputs(strand):
    rng = random.Random(strand)
    for _ in range(300):
        found = []
        for _ in range(rng.randrange(1, 7)):
            a = rng.randrange(0, 900)
            b = a + rng.randrange(1, 200)
            found.append(((a, b), (b + rng.randrange(60, 300), b + rng.randrange(300, 500))) if rng.random() < 0.5 else ((a, b),))
        out, counts = chains.overlapped(found, [rng.randrange(10, 50) for _ in found], strand, 50)
        assert len(out) == len(counts) and out == sorted(out) or len(found) == 1
        assert min(c[0][0] for c in out) == min(c[0][0] for c in found) and max(c[-1][1] for c in out) == max(c[-1][1] for c in found)
        assert all(a <= b for c in out for a, b in c) and all(x[1] < y[0] for c in out if c not in found for x, y in zip(c, c[1:], strict=False))


def test_gaps_without_a_junction_close():
    chain = ((10, 20), (100, 120))
    assert chains.gap_closed(chain, [21, 99]) == chain and chains.gap_closed(chain, [100]) == chain
    assert chains.gap_closed(chain, [5, 121]) == ((10, 120),)


def test_fold_takes_overlapping_neighbours_together():
    members = [([((0, 100),)], [10]), ([((90, 200),)], [20]), ([((300, 400),)], [30])]
    assert chains.folded(members, 0, 5) == [([((0, 200),)], [30], 2), ([((300, 400),)], [30], 1)]


GTF = """##description: test
chr1\tx\tgene\t25\t800\t.\t+\t.\tgene_id "g1";
chr1\tx\texon\t100\t300\t.\t+\t.\tref_gene_id "no"; gene_id "g1"; n "1";
chr1\tx\texon\t250\t500\t.\t+\t.\tgene_id "g1";
chr1\tx\tUTR\t501\t600\t.\t+\t.\tgene_id "g1";
chr1\tx\texon\t40\t60\t.\t-\t.\tgene_id "g2";
chr1\tx\texon\t700\t800\t.\t.\t.\tgene_id "g3";"""


def _annotation(spark, text=GTF, config=None):
    lines = spark.createDataFrame(list(enumerate(text.splitlines())), "line_no long, value string")
    return annotation.parsed(lines, config or Config())


def test_annotation_and_exon_union(spark):
    got = genes.exon_union(genes.gene_lines(_annotation(spark))).select("contig", "strand", "gene_id", "start", "stop").orderBy("gene_id", "start").collect()
    # touching intervals stay apart, overlapping ones are one
    assert [tuple(r) for r in got] == [("chr1", 0, "g1", 99, 499), ("chr1", 0, "g1", 500, 599), ("chr1", 1, "g2", 39, 59)]
    table = genes.gene_table(genes.exon_union(genes.gene_lines(_annotation(spark))))
    assert [r.value for r in sinks.gene_lines(table).collect()] == ["chr1 g2 39-59", "chr1 g1 99-499 500-599"]
    loose = _annotation(spark, config=Config(loose_feature_id=True)).where("start = 99").first()
    assert loose.gene_id == "no"
    with pytest.raises(Exception, match="no gene_id"):
        _annotation(spark, "chr1\tx\texon\t1\t2\t.\t+\t.\tname \"a\";").collect()
    assert annotation.separator_of("a.gff") == "=" and annotation.separator_of("a.gtf") == '"'
    with pytest.raises(ValueError):
        annotation.separator_of("a.gff3")


def test_interval_union_equals_a_model(spark):
    rng = random.Random(5)
    spans = [(k, a, a + rng.randrange(0, 30)) for k in range(5) for a in (rng.randrange(400) for _ in range(30))]
    got = {}
    for r in intervals.interval_union(spark.createDataFrame(spans, "k int, start int, stop int"), ["k"]).orderBy("start").collect():
        got.setdefault(r.k, []).append((r.start, r.stop))
    for k in range(5):
        want = []
        for _, a, b in sorted(s for s in spans if s[0] == k):
            if want and a <= want[-1][1]:
                want[-1] = (want[-1][0], max(b, want[-1][1]))
            else:
                want.append((a, b))
        assert got[k] == want


def test_exon_union_of_equal_lines_in_any_order(spark):
    """Equal lines are ties of the windows: neither their number nor their order may move one to another run."""
    rng = random.Random(7)
    lines = [("chr1", 0, "g", a, a + 80) for a in (100, 100, 150, 300, 381, 381, 500) for _ in range(20)]
    want = [(100, 230), (300, 380), (381, 461), (500, 580)]
    for parts in (1, 3, 7):
        rng.shuffle(lines)
        numbered = [(*line, i) for i, line in enumerate(lines)]
        df = spark.createDataFrame(numbered, "contig string, strand int, gene_id string, start int, stop int, line_no int").repartition(parts)
        assert sorted((r.start, r.stop) for r in genes.exon_union(df).collect()) == want


def test_interval_join_equals_nested_loops_for_any_bin(spark):
    rng = random.Random(6)
    left = [(k, a, a + rng.randrange(40)) for k in range(2) for a in (rng.randrange(500) for _ in range(40))]
    right = [(k, a, a + rng.randrange(40)) for k in range(2) for a in (rng.randrange(500) for _ in range(40))]
    a, b = spark.createDataFrame(left, "k int, l0 int, l1 int"), spark.createDataFrame(right, "k int, r0 int, r1 int")
    want = sorted((k, x0, x1, y0, y1) for k, x0, x1 in left for j, y0, y1 in right if k == j and x0 <= y1 and y0 <= x1)
    for width in (8, 1 << 14):
        assert sorted(map(tuple, intervals.interval_join(a, b, ["k"], ("l0", "l1"), ("r0", "r1"), width).select("k", "l0", "l1", "r0", "r1").collect())) == want


GENE = [(99, 199), (399, 499), (699, 799)]


def _exons(spark, strand=0, gene="a", spans=GENE):
    return spark.createDataFrame([("chr1", strand, gene, 1, *s) for s in spans], "contig string, strand int, gene_id string, run long, start int, stop int")


def _blocks(spark, spans, strand=0):
    return spark.createDataFrame([("chr1", strand, i, "9M", 1, 0, a, b) for i, (a, b) in enumerate(spans)], "contig string, strand int, pos int, cigar string, n long, block_ix int, left int, right int")


def test_read_overlap_scores_and_buckets(spark):
    spans = [(120, 180), (420, 480), (150, 250), (150, 450), (250, 350)]
    keys = ["contig", "strand", "pos", "cigar"]
    got = {r.pos: r.score for r in assign.read_scores(_blocks(spark, spans), _exons(spark), keys).collect()}
    assert [got.get(i, 0) for i in range(5)] == [2, 2, 1, 1, 0]
    found = assign.assign_reads(_blocks(spark, [spans[0], spans[1], spans[4]]), _exons(spark), Config())
    assert {r.status: r["count"] for r in found.groupBy("status").count().collect()} == {"assigned": 2, "unassigned": 1}
    reverse = assign.assign_reads(_blocks(spark, spans[:2], strand=1), _exons(spark), Config(strandedness="reverse"))
    assert [r.status for r in reverse.collect()] == ["assigned", "assigned"]


def test_two_equal_hits_in_one_gene_are_ambiguous_unless_genes_are_counted(spark):
    one = _blocks(spark, [(120, 180)])
    both = one.unionByName(one.select("contig", "strand", "pos", "cigar", "n", F.lit(1).alias("block_ix"), F.lit(420).alias("left"), F.lit(480).alias("right")))
    assert {r.status for r in assign.assign_reads(both, _exons(spark), Config()).collect()} == {"ambiguous"}
    assert {r.status for r in assign.assign_reads(both, _exons(spark), Config(count_distinct_genes=True)).collect()} == {"assigned"}


def test_transcript_overlap(spark):
    rows = [("chr1", 0, 0, i, [(a, b)]) for i, (a, b) in enumerate([(120, 180), (120, 600), (220, 360), (199, 260)])]
    tx = spark.createDataFrame(rows, "contig string, strand int, cluster int, tx_ix int, exons array<struct<start:int,stop:int>>")
    got = {r.tx_ix: r.score for r in assign.transcript_scores(tx, _exons(spark), ["contig", "strand", "cluster", "tx_ix"]).collect()}
    assert [got.get(i, 0) for i in range(4)] == [60, 179, 0, 0]  # one shared base counts as none


def test_unique_argmax(spark):
    rows = [(1, "a", 5), (1, "b", 3), (2, "a", 5), (2, "b", 3), (2, "c", 5), (3, "a", 0), (4, "a", 2), (4, "b", 2), (4, "c", 7)]
    got = {r.k: (r.status, r.value) for r in intervals.unique_argmax(spark.createDataFrame(rows, "k int, v string, s int"), ["k"], "s", "v").collect()}
    assert got == {1: ("assigned", "a"), 2: ("ambiguous", None), 3: ("unassigned", None), 4: ("assigned", "c")}
    rng = random.Random(8)
    rows = sorted({(rng.randrange(60), rng.randrange(3), rng.choice("abc"), rng.randrange(4)) for _ in range(400)})
    df = spark.createDataFrame(rows, "k int, block int, v string, s int")
    for told_apart, by in (([], lambda b, v: v), (["block"], lambda b, v: (b, v))):
        got = {r.k: (r.status, r.best, r.value) for r in intervals.unique_argmax(df, ["k"], "s", "v", told_apart).collect()}
        for k in {r[0] for r in rows}:
            best = max(s for j, _, _, s in rows if j == k)
            held = {by(b, v): v for j, b, v, s in rows if (j, s) == (k, best)}
            assert got[k] == (("unassigned", 0, None) if best == 0 else ("assigned", best, *held.values()) if len(held) == 1 else ("ambiguous", best, None))


def test_first_interval_ending_at_or_after(spark):
    spans = spark.createDataFrame([("chr1", "a", 99, 199), ("chr1", "b", 399, 499)], "contig string, v string, start int, stop int")
    points = spark.createDataFrame([("chr1", p) for p in (50, 199, 300, 600)] + [("chr2", 300)], "contig string, pos int")
    for width in (1 << 20, 64):
        got = {(r.contig, r.pos): r.nearest for r in intervals.first_ending_at_or_after(points, spans, ["contig"], "pos", "v", bin_width=width).collect()}
        assert got == {("chr1", 50): "a", ("chr1", 199): "a", ("chr1", 300): "b", ("chr1", 600): None, ("chr2", 300): None}


def test_ratio_allocation_of_nothing_is_nothing(spark):
    df = spark.createDataFrame([(1, 3, 10), (1, 1, 10), (2, 0, 10)], "k int, part long, total long")
    assert sorted((r.k, r.part, r.share) for r in intervals.ratio_allocate(df, ["k"], "part", "total").collect()) == [(1, 1, 2.5), (1, 3, 7.5), (2, 0, 0.0)]


def _run_reads(spark):
    rows = [(1000 + i % 5, 0, 9, 1, "50M") for i in range(60)] + [(5000 + i % 7, 16, 9, 1, "20M500N20M") for i in range(40)] + [(9000, 0, 9, 1, "30M")] * 5 + [(1000, 0, 0, 1, "50M")] * 3
    return _reads(spark, rows)


def test_whole_run_adds_up(spark):
    found = pipeline.find(_run_reads(spark), Config(min_count=10))
    tx = found.transcripts.collect()
    assert {(r.strand, r.cluster): r.counts for r in tx} == {(0, 1000): 60.0, (1, 5000): 40.0}
    notes = "\n".join(f"chr1\tx\texon\t{a}\t{b}\t.\t{s}\t.\tgene_id \"{g}\";" for a, b, s, g in ((1001, 1101, "+", "g1"), (5001, 5021, "-", "g2"), (8991, 9100, "+", "g3")))
    _, counts, summary = pipeline.counted(_run_reads(spark), _annotation(spark, notes), Config(min_count=10))
    assert {r.gene_id: r.reads for r in counts.collect()} == {"g1": 60.0, "g2": 40.0, "g3": 5.0}
    rows = {r.metric: r.value for r in sinks.summary_rows(summary).collect()}
    assert rows == {"assigned": "105.00", "unassigned": "0.00", "ambiguous": "0.00", "multimapping": "0", "low_quality": "3", "total": "108", "transcripts": "2"}
    assert [r.value for r in sinks.count_rows(counts).collect()] == ["g1\t60", "g2\t40", "g3\t5"]


def test_gtf_rows_are_in_order_and_from_one(spark, tmp_path):
    found = pipeline.find(_run_reads(spark), Config(min_count=10))
    rows = sinks.gtf_rows(found.transcripts, Config())
    sinks.write_gtf(rows, f"{tmp_path}/out.gtf", Config())
    text = (tmp_path / "out.gtf").read_text().splitlines()
    assert [x.startswith("##") for x in text[:5]] == [True] * 4 + [False]
    lines = [x.split("\t") for x in text[4:]]
    assert [r.value for r in sinks.cluster_lines(found.clusters).collect()] == ["chr1\t1000\t2000\t60", "chr1\t9000\t10000\t5", "chr1\t5000\t6000\t40"]
    assert [x[2] for x in lines[:3]] == ["gene", "transcript", "exon"] and {x[6] for x in lines} == {"+", "-"}
    first = next(x for x in lines if x[2] == "gene" and x[6] == "+")
    assert first[3] == "1001" and 'gene_id "Peak.chr1:1001-' in first[8]


def test_empty_inputs_give_no_rows(spark):
    none = spark.createDataFrame([], READS)
    found = pipeline.find(none, Config())
    assert found.transcripts.count() == 0 and found.clusters.count() == 0
    assert reads.reject_summary(none, Config()).count() == 0


def test_config_refuses_nonsense():
    with pytest.raises(ValueError):
        Config(strandedness="both")
    assert Config(min_count=1).least_reads == 10
