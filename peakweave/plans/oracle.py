"""The registered queries in SQL that DuckDB runs on the same tables, from shared common table expressions."""

from __future__ import annotations

from peakweave.sources.derived import GENE_LINES_SQL, READS_SQL

W, EPS, PCT, LEAST = 1000, 50, 5, 25
KEY = "contig, strand, cluster"

_CTE = {
    "reads": READS_SQL,
    "judged": """SELECT *, CASE WHEN (flag & 1024) <> 0 THEN 'duplicate' WHEN (flag & 4) <> 0 THEN 'unmapped'
        WHEN coalesce(nh, 1) > 1 OR (flag & 256) <> 0 THEN 'multimapped' WHEN mapq < 1 THEN 'low_quality' END AS reject_reason,
        CASE WHEN (flag & 16) <> 0 THEN 1 ELSE 0 END AS strand FROM reads""",
    "alignments": "SELECT contig, strand, pos, cigar, count(*) AS n FROM judged WHERE reject_reason IS NULL GROUP BY ALL",
    "counted": "SELECT contig, strand, pos, CAST(sum(n) AS BIGINT) AS n FROM alignments GROUP BY ALL",
    "lagged": "SELECT *, lag(pos) OVER (PARTITION BY contig, strand ORDER BY pos) AS lp FROM counted",
    "marked": f"SELECT *, sum(CASE WHEN lp IS NULL OR pos - lp > {W} THEN 1 ELSE 0 END) OVER (PARTITION BY contig, strand ORDER BY pos) AS i FROM lagged",
    "placed": "SELECT *, min(pos) OVER (PARTITION BY contig, strand, i) AS island FROM marked",
    "islands": f"""SELECT contig, strand, island, list_reduce(list(pos ORDER BY pos), lambda a, p: CASE WHEN p > a + {W} THEN p ELSE a END) AS last_anchor,
        CAST(sum(n) AS BIGINT) AS read_count FROM placed GROUP BY contig, strand, island""",
    "edges": f"""SELECT *, CASE WHEN lag(last_anchor) OVER w IS NULL OR island - lag(last_anchor) OVER w > 2 * {W} THEN island END AS st
        FROM islands WINDOW w AS (PARTITION BY contig, strand ORDER BY island)""",
    "joined": "SELECT *, max(st) OVER (PARTITION BY contig, strand ORDER BY island ROWS UNBOUNDED PRECEDING) AS cluster FROM edges",
    "clusters": f"SELECT contig, strand, cluster, min(island) AS start, max(last_anchor) + {W} AS stop, CAST(sum(read_count) AS BIGINT) AS read_count FROM joined GROUP BY ALL",
    "pattern": """SELECT * FROM (VALUES ('90M', 0, 0, 89), ('10S60M5D20M', 0, 0, 79), ('40M380N40M', 0, 0, 459), ('20M60N30M60N30M', 0, 0, 109),
        ('20M60N30M60N30M', 1, 80, 199)) t(cigar, block_ix, l, r)""",
    "gap": "SELECT * FROM (VALUES ('40M380N40M', 41), ('20M60N30M60N30M', 21), ('20M60N30M60N30M', 111)) t(cigar, j)",
    "blocks": """SELECT a.contig, a.strand, a.pos, a.cigar, a.n, p.block_ix, a.pos + p.l AS "left", a.pos + p.r AS "right" FROM alignments a JOIN pattern p USING (cigar)""",
    "located": f"SELECT b.*, c.cluster, greatest(CAST(floor(c.read_count * ({PCT} / 100.0)) AS INT), 10) AS least, c.read_count FROM blocks b JOIN clusters c ON b.contig = c.contig AND b.strand = c.strand AND b.pos BETWEEN c.cluster AND c.stop",
    "gene_lines": GENE_LINES_SQL,
    "exon_edges": """SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY contig, strand, gene_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        THEN 0 ELSE 1 END AS fresh FROM gene_lines""",
    "exon_runs": "SELECT *, sum(fresh) OVER (PARTITION BY contig, strand, gene_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS r FROM exon_edges",
    "exons": "SELECT contig, strand, gene_id, min(start) AS start, max(stop) AS stop FROM exon_runs GROUP BY contig, strand, gene_id, r",
    "genes": "SELECT contig, strand, gene_id, min(start) AS start, max(stop) AS stop FROM exons GROUP BY ALL",
}

# reads by their strand, in a reverse-stranded library, and with genes counted instead of hits
for _p, _facing, _hits in (("", "e.strand", "*"), ("reverse_", "1 - e.strand", "*"), ("distinct_", "e.strand", "DISTINCT h.gene_id")):
    _CTE |= {
        f"{_p}read_hits": f"""SELECT b.contig, b.strand, b.pos, b.cigar, b.n, b.block_ix, e.gene_id,
            max(CASE WHEN b."left" BETWEEN e.start AND e.stop THEN 1 ELSE 0 END + CASE WHEN b."right" BETWEEN e.start AND e.stop THEN 1 ELSE 0 END) AS score
            FROM blocks b JOIN exons e ON b.contig = e.contig AND b.strand = {_facing} AND b."left" <= e.stop AND e.start <= b."right" GROUP BY ALL""",
        f"{_p}read_best": f"SELECT contig, strand, pos, cigar, n, max(score) AS best FROM {_p}read_hits GROUP BY ALL",
        f"{_p}read_top": f"""SELECT b.contig, b.strand, b.pos, b.cigar, b.n, count({_hits}) AS k, min(h.gene_id) AS gene_id FROM {_p}read_best b JOIN {_p}read_hits h
            USING (contig, strand, pos, cigar) WHERE h.score = b.best AND b.best > 0 GROUP BY ALL""",
        f"{_p}read_status": f"""SELECT a.contig, a.strand, a.pos, a.cigar, a.n, CASE WHEN t.k IS NULL THEN 'unassigned' WHEN t.k = 1 THEN 'assigned' ELSE 'ambiguous' END AS status,
            CASE WHEN t.k = 1 THEN t.gene_id END AS gene_id FROM alignments a LEFT JOIN {_p}read_top t USING (contig, strand, pos, cigar)""",
    }

for _side in ("left", "right"):
    _CTE |= {
        f"{_side}_points": f'SELECT {KEY}, "{_side}" AS pos, least, CAST(sum(n) AS BIGINT) AS n FROM located WHERE read_count >= {LEAST} GROUP BY ALL',
        f"{_side}_near": f"SELECT *, CAST(sum(n) OVER (PARTITION BY {KEY} ORDER BY pos RANGE BETWEEN {EPS} PRECEDING AND {EPS} FOLLOWING) - 1 AS BIGINT) AS neighbours FROM {_side}_points",
        f"{_side}_core": f"SELECT *, neighbours >= least AS core, CASE WHEN neighbours >= least THEN pos END AS core_pos FROM {_side}_near",
        f"{_side}_seen": f"""SELECT *, max(core_pos) OVER (PARTITION BY {KEY} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lc,
            min(core_pos) OVER (PARTITION BY {KEY} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rc FROM {_side}_core""",
        f"{_side}_run": f"""SELECT *, sum(CASE WHEN core AND (lc IS NULL OR pos - lc > {EPS}) THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY pos) - 1 AS run FROM {_side}_seen""",
        f"{_side}_labels": f"""SELECT {KEY}, pos, n, neighbours, core, CAST(CASE WHEN core OR pos - lc <= {EPS} THEN run WHEN rc - pos <= {EPS} THEN run + 1 END AS INT) AS label FROM {_side}_run""",
        f"{_side}_regions": f"SELECT {KEY}, label, min(pos) AS lo, max(pos) AS hi FROM {_side}_labels WHERE core GROUP BY ALL",
    }

_CTE |= {
    "path_counts": """SELECT b.contig, b.strand, b.cluster, l.label AS five, r.label AS three, CAST(sum(b.n) AS BIGINT) AS n FROM located b
        JOIN left_labels l ON l.contig = b.contig AND l.strand = b.strand AND l.cluster = b.cluster AND l.pos = b."left"
        JOIN right_labels r ON r.contig = b.contig AND r.strand = b.strand AND r.cluster = b.cluster AND r.pos = b."right"
        WHERE l.label IS NOT NULL OR r.label IS NOT NULL GROUP BY ALL""",
    "path_shares": f"SELECT *, count(*) OVER (PARTITION BY {KEY}, five) AS f5, count(*) OVER (PARTITION BY {KEY}, three) AS f3 FROM path_counts",
    "paths": f"SELECT {KEY}, five, three, n FROM path_shares WHERE NOT ((three IS NULL AND f5 > 1) OR (five IS NULL AND f3 > 1)) AND n >= 10",
    "spans": """SELECT p.*, l.lo AS l0, l.hi AS l1, r.lo AS r0, r.hi AS r1 FROM paths p
        LEFT JOIN left_regions l ON l.contig = p.contig AND l.strand = p.strand AND l.cluster = p.cluster AND l.label = p.five
        LEFT JOIN right_regions r ON r.contig = p.contig AND r.strand = p.strand AND r.cluster = p.cluster AND r.label = p.three""",
    "turned": """SELECT *, CASE WHEN r0 < l0 THEN r0 ELSE l0 END AS t0, CASE WHEN r0 < l0 THEN r1 ELSE l1 END AS t1,
        CASE WHEN r0 < l0 THEN l0 ELSE r0 END AS t2, CASE WHEN r0 < l0 THEN l1 ELSE r1 END AS t3 FROM spans""",
    "segments": f"""SELECT {KEY}, five, three, n,
        CASE WHEN l0 IS NULL OR r0 IS NULL THEN coalesce(l0, r0) WHEN abs(t2 - t1) <= {EPS} THEN t0 WHEN t2 <= t1 THEN least(t0, t2) ELSE t0 END AS start1,
        CASE WHEN l0 IS NULL OR r0 IS NULL THEN coalesce(l1, r1) WHEN abs(t2 - t1) <= {EPS} THEN t3 WHEN t2 <= t1 THEN greatest(t1, t3) ELSE t1 END AS stop1,
        CASE WHEN l0 IS NOT NULL AND r0 IS NOT NULL AND abs(t2 - t1) > {EPS} AND t2 > t1 THEN t2 END AS start2,
        CASE WHEN l0 IS NOT NULL AND r0 IS NOT NULL AND abs(t2 - t1) > {EPS} AND t2 > t1 THEN t3 END AS stop2 FROM turned""",
    "parts": f"SELECT {KEY}, five, three, start1 AS a, stop1 AS b FROM segments UNION ALL SELECT {KEY}, five, three, start2, stop2 FROM segments WHERE start2 IS NOT NULL",
    "path_scores": f"""SELECT p.contig, p.strand, p.cluster, p.five, p.three, e.gene_id, CAST(sum(greatest(least(p.b, e.stop) - greatest(p.a, e.start), 0)) AS BIGINT) AS score
        FROM parts p JOIN exons e ON p.contig = e.contig AND p.strand = e.strand AND p.a <= e.stop AND e.start <= p.b GROUP BY ALL""",
}


def sql(last: str) -> str:
    """``last`` after the common table expressions that it needs, in order."""
    text, names = last, []
    for name in reversed(list(_CTE)):
        if any(name in _words(t) for t in (text, *(_CTE[n] for n in names))):
            names.insert(0, name)
    return "WITH " + ", ".join(f"{n} AS ({_CTE[n]})" for n in names) + f" {last}"


def _words(text: str) -> set[str]:
    return set("".join(c if c.isalnum() or c == "_" else " " for c in text).split())


ORACLE_SQL = {
    "read_reject_summary": sql("""SELECT contig, count(*) AS total, count(*) FILTER (reject_reason = 'duplicate') AS duplicate, count(*) FILTER (reject_reason = 'unmapped') AS unmapped,
        count(*) FILTER (reject_reason = 'multimapped') AS multimapped, count(*) FILTER (reject_reason = 'low_quality') AS low_quality,
        count(*) FILTER (reject_reason IS NULL AND strand = 0) AS passing_forward, count(*) FILTER (reject_reason IS NULL AND strand = 1) AS passing_reverse FROM judged GROUP BY contig"""),
    "contig_catalogue": sql("SELECT contig, contig_index, count(*) AS reads FROM reads GROUP BY ALL"),
    "splice_blocks": sql('SELECT contig, strand, pos, cigar, n, block_ix, "left", "right" FROM blocks'),
    "splice_junctions": sql("SELECT contig, strand, a.pos + g.j AS junction, CAST(sum(n) AS BIGINT) AS n FROM alignments a JOIN gap g USING (cigar) GROUP BY ALL"),
    "gap_islands": sql("SELECT contig, strand, island, last_anchor, read_count FROM islands"),
    "read_clusters": sql("SELECT contig, strand, cluster, start, stop, read_count FROM clusters"),
    "cluster_density": sql(f"""SELECT {KEY}, read_count, greatest(CAST(floor(read_count * ({PCT} / 100.0)) AS INT), 10) AS least FROM clusters
        WHERE read_count >= {LEAST} AND CAST(read_count AS FLOAT) / CAST(stop - start AS FLOAT) < CAST(0.2 AS DOUBLE)"""),
    "dense_clusters": sql(f"SELECT {KEY}, read_count FROM clusters WHERE read_count >= {LEAST} AND CAST(read_count AS FLOAT) / CAST(stop - start AS FLOAT) >= CAST(0.2 AS DOUBLE)"),
    "block_spans": sql('SELECT contig, strand, pos, cigar, min("left") AS least, max("right") AS greatest FROM blocks GROUP BY ALL'),
    "range_neighbours": sql(f"SELECT {KEY}, pos, n, neighbours FROM left_near"),
    "dbscan_labels_left": sql(f"SELECT {KEY}, pos, n, neighbours, core, label FROM left_labels"),
    "dbscan_labels_right": sql(f"SELECT {KEY}, pos, n, neighbours, core, label FROM right_labels"),
    "dbscan_regions_left": sql(f"SELECT {KEY}, label, lo, hi FROM left_regions"),
    "dbscan_regions_right": sql(f"SELECT {KEY}, label, lo, hi FROM right_regions"),
    "peak_paths": sql(f"SELECT {KEY}, five, three, n FROM paths"),
    "peak_coordinates": sql(f"SELECT {KEY}, five, three, n, start1, stop1, start2, stop2 FROM segments"),
    "path_gene_overlap": sql(f"SELECT {KEY}, five, three, gene_id, score FROM path_scores"),
    "path_gene_assignment": sql(f"""SELECT {KEY}, five, three, CASE WHEN max(score) = 0 THEN 'unassigned' WHEN count(*) FILTER (score = best) = 1 THEN 'assigned' ELSE 'ambiguous' END AS status,
        max(score) AS best FROM (SELECT *, max(score) OVER (PARTITION BY {KEY}, five, three) AS best FROM path_scores) t GROUP BY {KEY}, five, three"""),
    "ratio_allocation": sql(f"SELECT {KEY}, five, three, round(p.n / sum(p.n) OVER (PARTITION BY {KEY}) * c.read_count, 6) AS share FROM paths p JOIN clusters c USING ({KEY})"),
    "gene_exon_union": sql("SELECT contig, strand, gene_id, start, stop FROM exons"),
    "gene_extents": sql("SELECT contig, strand, gene_id, min(start) AS start, max(stop) AS stop, count(*) AS n_exons FROM exons GROUP BY ALL"),
    "annotation_lines": sql("SELECT contig AS seqname, strand, gene_id, start, stop FROM gene_lines"),
    "feature_count": sql("SELECT count(*) AS features FROM gene_lines"),
    "strand_interleave": sql("SELECT contig, strand, gene_id, start, CAST(row_number() OVER (PARTITION BY contig ORDER BY start, strand, gene_id) AS INT) AS place FROM genes"),
    "read_gene_assignment": sql("SELECT contig, strand, pos, cigar, n, status, gene_id FROM read_status"),
    "read_status_totals": sql("SELECT contig, status, CAST(sum(n) AS BIGINT) AS reads FROM read_status GROUP BY ALL"),
    "gene_read_counts": sql("""SELECT g.contig, g.strand, g.gene_id, CAST(coalesce(sum(s.n), 0) AS DOUBLE) AS reads FROM genes g
        LEFT JOIN read_status s ON s.contig = g.contig AND s.strand = g.strand AND s.gene_id = g.gene_id GROUP BY ALL"""),
    "unsearched_run_counts": sql("""SELECT g.contig, g.strand, g.gene_id, CAST(coalesce(sum(s.n), 0) AS DOUBLE) AS reads FROM genes g
        LEFT JOIN read_status s ON s.contig = g.contig AND s.strand = g.strand AND s.gene_id = g.gene_id GROUP BY ALL"""),
    "unsearched_reverse_run_counts": sql("""SELECT g.contig, g.strand, g.gene_id, CAST(coalesce(sum(s.n), 0) AS DOUBLE) AS reads FROM genes g
        LEFT JOIN reverse_read_status s ON s.contig = g.contig AND s.strand = 1 - g.strand AND s.gene_id = g.gene_id GROUP BY ALL"""),
    "unsearched_run_summary": sql("""SELECT CAST(place AS INT) AS place, status AS metric, printf('%.2f', CAST(coalesce(sum(n), 0) AS DOUBLE)) AS value
        FROM (VALUES (0, 'assigned'), (1, 'unassigned'), (2, 'ambiguous')) t(place, status) LEFT JOIN read_status USING (status) GROUP BY place, status
        UNION ALL SELECT 3, 'multimapping', CAST(count(*) FILTER (reject_reason = 'multimapped') AS VARCHAR) FROM judged
        UNION ALL SELECT 4, 'low_quality', CAST(count(*) FILTER (reject_reason = 'low_quality') AS VARCHAR) FROM judged
        UNION ALL SELECT 5, 'total', CAST(count(*) AS VARCHAR) FROM judged UNION ALL SELECT 6, 'transcripts', '0'"""),
    "nonunique_reject_summary": sql("""SELECT contig, count(*) AS total, count(*) FILTER (reason = 'duplicate') AS duplicate, count(*) FILTER (reason = 'unmapped') AS unmapped,
        count(*) FILTER (reason = 'multimapped') AS multimapped, count(*) FILTER (reason = 'low_quality') AS low_quality,
        count(*) FILTER (reason IS NULL AND strand = 0) AS passing_forward, count(*) FILTER (reason IS NULL AND strand = 1) AS passing_reverse
        FROM (SELECT *, CASE WHEN reject_reason <> 'multimapped' THEN reject_reason WHEN mapq < 1 THEN 'low_quality' END AS reason FROM judged) t GROUP BY contig"""),
    "distinct_gene_assignment": sql("SELECT contig, strand, pos, cigar, n, status, gene_id FROM distinct_read_status"),
    "reverse_strand_counts": sql("""SELECT g.contig, g.strand, g.gene_id, g.start, g.stop, CAST((SELECT coalesce(sum(c.n), 0) FROM counted c WHERE c.contig = g.contig AND c.strand = 1 - g.strand
        AND c.pos BETWEEN g.start AND g.stop) AS BIGINT) AS reads FROM genes g"""),
    "closest_interval": sql("""SELECT DISTINCT c.contig, c.strand, c.pos, (SELECT arg_min(g.gene_id, (g.start, g.stop, g.gene_id)) FROM genes g
        WHERE g.contig = c.contig AND g.strand = c.strand AND g.stop >= c.pos) AS nearest FROM counted c"""),
    "mirror_intervals": sql(f"SELECT {KEY}, five, three, -coalesce(stop2, stop1) AS start1, -coalesce(start2, start1) AS stop1, CASE WHEN start2 IS NOT NULL THEN -stop1 END AS start2, CASE WHEN start2 IS NOT NULL THEN -start1 END AS stop2 FROM segments"),
    "event_sessions": """SELECT user_id, island, count(*) AS n, CAST(max(pos) AS BIGINT) AS last FROM (SELECT *, max(st) OVER (PARTITION BY user_id ORDER BY pos RANGE UNBOUNDED PRECEDING) AS island
        FROM (SELECT user_id, pos, CASE WHEN lp IS NULL OR pos - lp > 3600 THEN pos END AS st FROM (SELECT user_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS pos,
        lag(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts) AS lp FROM events) a) b) c GROUP BY ALL""",
}
