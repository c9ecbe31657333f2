"""Reads and annotation lines derived from the benchmark tables, by expressions that mean the same in other SQL engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

READS_SQL = """
SELECT contig_index, concat('chr', CAST(contig_index + 1 AS STRING)) AS contig,
       k * 4000 - CASE WHEN k % 4 = 3 THEN 1700 ELSE 0 END + CASE WHEN ln = 6 THEN ep % 1300 ELSE pk * 420 + qty END AS pos, flag, mapq, nh, cigar
FROM (SELECT CAST(l_suppkey % 3 AS INT) AS contig_index, CAST(l_partkey % 20 AS INT) AS k, CAST(l_orderkey % 3 AS INT) AS pk, l_linenumber AS ln,
        CAST(l_quantity AS INT) AS qty, CAST(floor(l_extendedprice) AS INT) AS ep,
        (CASE WHEN l_linestatus = 'F' THEN 0 ELSE 16 END) + (CASE WHEN l_returnflag = 'A' AND l_quantity = 1 THEN 1024 ELSE 0 END)
          + (CASE WHEN l_linenumber = 7 AND l_quantity <= 5 THEN 256 ELSE 0 END) AS flag,
        CAST(round(l_discount * 100) AS INT) AS mapq, CASE WHEN round(l_tax * 100) = 8 THEN 2 ELSE 1 END AS nh,
        CASE WHEN l_orderkey % 3 = 0 AND l_linenumber <= 2 THEN '40M380N40M' WHEN l_linenumber = 3 THEN '20M60N30M60N30M'
             WHEN l_linenumber = 4 THEN '10S60M5D20M' ELSE '90M' END AS cigar
      FROM lineitem) t"""

GENE_LINES_SQL = """
SELECT concat('chr', CAST(p_partkey % 3 + 1 AS STRING)) AS contig, CAST(floor(p_partkey / 3) % 2 AS INT) AS strand,
       concat('G', CAST(p_partkey % 6 AS STRING), '_', CAST(k AS STRING), '_', CAST(CAST(floor(p_partkey / 120) % 2 AS INT) AS STRING)) AS gene_id,
       k * 4000 - CASE WHEN k % 4 = 3 THEN 1700 ELSE 0 END + (p_size % 3) * 420 + p_size AS start,
       k * 4000 - CASE WHEN k % 4 = 3 THEN 1700 ELSE 0 END + (p_size % 3) * 420 + p_size + 80 AS stop, p_partkey AS part
FROM (SELECT p_partkey, p_size, CAST(floor(p_partkey / 6) % 20 AS INT) AS k FROM part) t"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments, one for each row of lineitem."""
    return spark.sql(READS_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def gene_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exon lines ``contig, strand, gene_id, start, stop, line_no``; the lines of a gene stand together."""
    lines = spark.sql(GENE_LINES_SQL.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return lines.selectExpr("contig", "strand", "gene_id", "start", "stop", "xxhash64(gene_id) AS block", "part").selectExpr("contig", "strand", "gene_id", "start", "stop", "struct(block, part) AS line_no")
