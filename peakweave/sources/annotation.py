"""Gene annotation in tab-separated text (GTF or GFF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakweave.config import Config

COLUMNS = ("seqname", "source", "feature", "start", "stop", "score", "strand", "frame", "attributes")


def separator_of(path: str) -> str:
    """What stands between an attribute's key and its value: a quote in ``.gtf``, an equals sign in ``.gff``; other files are refused."""
    for suffix, mark in ((".gtf", '"'), (".gff", "=")):
        if path.endswith(suffix):
            return mark
    raise ValueError(f"{path}: neither .gtf nor .gff")


def attribute(attributes: Column, key: str, mark: str, loose: bool = False) -> Column:
    """The value of the first attribute with this key (loosely: whose text holds it), or null."""
    parts = F.split(attributes, ";")
    if loose:
        own = F.filter(parts, lambda x: F.contains(x, F.lit(key)))
    else:
        name = r"^\s*\Q" + key + r"\E\s*" + ("=" if mark == "=" else r'\s"')
        own = F.filter(parts, lambda x: x.rlike(name))
    return F.get(F.split(F.get(own, F.lit(0)), mark), F.lit(1))


def parsed(lines: DataFrame, config: Config, mark: str = '"') -> DataFrame:
    """Rows ``line_no, value`` as annotation lines of the wanted features: the nine columns and ``gene_id``, with positions from 0.

    Comments and other features are left out, missing columns are null, rows whose strand is neither + nor - are
    rejected, and a wanted line without the attribute is an error.
    """
    parts = F.split("value", "\t")
    split = lines.where(~F.col("value").startswith("#")).select("line_no", *(F.get(parts, F.lit(k)).alias(c) for k, c in enumerate(COLUMNS)))
    wanted = split.where(F.col("feature").isin(config.feature_tag, config.utr_tag) & F.col("strand").isin("+", "-"))
    gene = attribute(F.col("attributes"), config.feature_id, mark, config.loose_feature_id)
    checked = F.coalesce(gene, F.raise_error(F.concat(F.lit(f"no {config.feature_id} in: "), F.coalesce("attributes", F.lit("")))))
    spans = {"start": F.col("start").cast("int") - 1, "stop": F.col("stop").cast("int") - 1}
    return wanted.withColumns(spans).withColumn("gene_id", checked)


def read_annotation(spark: SparkSession, path: str, config: Config) -> DataFrame:
    """An annotation file. Splits of a file are read as partitions in its order, so line numbers rise along it."""
    mark = separator_of(path)
    text = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    return parsed(text.select("line_no", "value"), config, mark)
