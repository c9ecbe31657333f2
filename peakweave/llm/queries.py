"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakweave.llm import decontamination, embedding_dedup, language, line_dedup, packing, quality, sharding, simhash, url_filter, warc
from peakweave.llm._shared import table


def op1_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), url_filter.train_rows(url_filter.seed_urls()))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_archives(index)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.minimax_shards(table(spark, sf_dir, "documents"))


def op6_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op8_log_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op9_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_url_trees, op2_embedding_near_dedup, op3_warc_index_merge, op4_benchmark_decontamination, op5_minimax_sharding, op6_quality_neighbours, op7_language_hierarchy, op8_log_template_line_dedup, op9_differencing_packing, op10_simhash_near_dedup,)}

ORACLE_SQL: dict[str, str] = {
    "op3_warc_index_merge": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        f AS (SELECT html, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY html)
        SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest,
               CASE WHEN p.page_id <> f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN p.page_id <> f.first_id THEN f.first_id END AS refers_to
        FROM p LEFT JOIN f ON p.html = f.html""",
    "op2_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
               AND len(list_filter(e, lambda x: x <> 0)) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                 WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.other),
        c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
        SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op4_benchmark_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
        i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM benchmark WHERE text IS NOT NULL),
        dp AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 4, 1))) AS pos FROM d WHERE len(ws) > 0),
        ip AS (SELECT item_id, ws, unnest(range(0, greatest(len(ws) - 4, 1))) AS j FROM i WHERE len(ws) > 0),
        ds AS (SELECT doc_id, pos, greatest(len(ws) - 4, 1) AS size, CASE WHEN len(ws) >= 5 THEN '' ELSE 'whole ' END || array_to_string(ws[pos + 1 : pos + 5], ' ') AS sh FROM dp),
        sh AS (SELECT item_id, j, greatest(len(ws) - 4, 1) AS m, CASE WHEN len(ws) >= 5 THEN '' ELSE 'whole ' END || array_to_string(ws[j + 1 : j + 5], ' ') AS sh FROM ip),
        mine AS (SELECT DISTINCT item_id, m, sh FROM sh),
        hit AS (SELECT ds.doc_id, mine.item_id, mine.m, least(mine.m, ds.size) AS w, ds.size, ds.pos, ds.sh FROM ds JOIN mine USING (sh)),
        every AS (SELECT doc_id, item_id, m, w, sh, unnest(range(greatest(0, pos - w + 1), least(pos, size - w) + 1)) AS start FROM hit),
        win AS (SELECT doc_id, item_id, start, m, w, sh, count(*) AS k FROM every GROUP BY ALL),
        it AS (SELECT item_id, sh, count(*) AS k FROM sh GROUP BY ALL),
        same AS (SELECT win.doc_id, win.item_id, win.start, win.m, win.w, sum(least(win.k, it.k)) AS s FROM win JOIN it ON it.item_id = win.item_id AND it.sh = win.sh GROUP BY ALL),
        leak AS (SELECT doc_id, item_id, max(s / (m + w - s)) AS similarity FROM same WHERE s / (m + w - s) >= 0.8 GROUP BY ALL),
        best AS (SELECT doc_id, count(*) AS n_items, arg_max(item_id, (similarity, -item_id)) AS item_id, max(similarity) AS similarity FROM leak GROUP BY doc_id)
        SELECT a.doc_id, b.doc_id IS NOT NULL AS contaminated, coalesce(b.n_items, 0) AS n_items, b.item_id, b.similarity FROM documents a LEFT JOIN best b ON a.doc_id = b.doc_id""",
    "op8_log_template_line_dedup": """
        WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM raw),
        raw_t AS (SELECT doc_id, pos, string_split(trim(line, chr(32) || chr(9) || chr(13)), ' ') AS us FROM l WHERE trim(line, chr(32) || chr(9) || chr(13)) <> ''),
        t AS (SELECT doc_id, pos, us, list_transform(us, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS ms FROM raw_t WHERE len(us) >= 3),
        k AS (SELECT doc_id, pos, (len(ms), ms[1], ms[2], ms[3]) AS leaf, len(list_filter(ms, lambda x: x <> '<*>')) >= 0.7 * len(ms) AS firm,
              CASE WHEN len(list_filter(ms, lambda x: x <> '<*>')) >= 0.7 * len(ms) THEN ms ELSE us END AS ts FROM t),
        o AS (SELECT leaf, firm, ts, count(DISTINCT doc_id) AS docs FROM k GROUP BY ALL),
        tok AS (SELECT leaf, ts, docs, unnest(range(0, len(ts))) AS p, unnest(ts) AS x FROM o WHERE firm),
        com AS (SELECT leaf, p, x FROM tok GROUP BY ALL HAVING sum(docs) >= 3),
        gen AS (SELECT tok.leaf, tok.ts, list(CASE WHEN com.p IS NOT NULL THEN tok.x ELSE '<*>' END ORDER BY tok.p) AS shape,
                avg(CASE WHEN com.p IS NOT NULL AND tok.x <> '<*>' THEN 1.0 ELSE 0.0 END) AS kept
                FROM tok LEFT JOIN com ON com.leaf = tok.leaf AND com.p = tok.p AND com.x = tok.x WHERE tok.docs < 3 GROUP BY tok.leaf, tok.ts),
        tpl AS (SELECT leaf, firm, ts, ts AS shape FROM o WHERE docs >= 3 UNION ALL SELECT leaf, true, ts, shape FROM gen WHERE kept >= 0.7),
        pl AS (SELECT k.doc_id, k.pos, tpl.leaf, tpl.firm, tpl.shape FROM k JOIN tpl ON tpl.leaf = k.leaf AND tpl.firm = k.firm AND tpl.ts = k.ts),
        rec AS (SELECT leaf, firm, shape, min(doc_id) AS first_doc FROM pl GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
        gone AS (SELECT DISTINCT pl.doc_id, pl.pos FROM pl JOIN rec ON rec.leaf = pl.leaf AND rec.firm = pl.firm AND rec.shape = pl.shape WHERE pl.doc_id <> rec.first_doc),
        r AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL), '') AS text
              FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos GROUP BY l.doc_id)
        SELECT d.doc_id, CAST(coalesce(r.n_lines, 0) AS INT) AS n_lines, CAST(coalesce(r.n_dropped, 0) AS INT) AS n_dropped, r.text FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id""",
}
