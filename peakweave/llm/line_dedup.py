"""Line dedup by a log-template tree.

Lines are parsed at a fixed depth: the root branches by token count, each node
below by one of the leading tokens, a token with a digit being a variable field
(``<*>``). In a leaf, a position keeps a token that occurs there in at least
``min_docs`` documents' lines; other tokens are variable fields too. A line's
template is what stays. A template that keeps at least ``min_kept`` of its
tokens and recurs in ``min_docs`` documents or more is dropped from all of them
but the first, so that one copy of whatever recurs stays in the corpus. A line
of more variable fields than that is its own template: it recurs only word for
word, and supports no other.

Everything is built-in column functions. Lines and templates are told apart by
two hashes of 64 bits each. Of line texts, only those of crowded leaves are
written, and only one copy of each distinct one is looked at token by token.
Documents that lose lines are joined by their id and a hash of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakweave.llm._shared import fits, materialise

DEPTH, MIN_DOCS, MIN_TOKENS, MIN_KEPT, FIELD = 3, 3, 3, 0.7, "<*>"
#: Leaves, tokens and templates up to this number are broadcast (16 to 40 bytes each), and so are as many lines to drop; more are joined by shuffle.
BROADCAST_ROWS = 20_000


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), FIELD).otherwise(t))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row, pos, line`` of every line; row is a hash of the text. A null text has none."""
    text = F.col(text_col).cast("string")
    # outer, or the optimiser infers a filter on the array and splits every text twice
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.posexplode_outer(F.split(text, "\n")).alias("pos", "raw"))
    return each.select("doc_id", "row", "pos", F.btrim("raw", F.lit(" \t\r")).alias("line"))


def _leaf(line: Column, depth: int) -> Column:
    """A hash of the token count and the leading tokens, variable fields masked."""
    lead = F.substring_index(line, " ", depth)
    lead = F.when(lead.rlike("[0-9]"), F.array_join(_masked(F.split(lead, " ")), " ")).otherwise(lead)
    return F.xxhash64(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))), lead)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits(df, BROADCAST_ROWS) else df


def recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, min_kept: float = MIN_KEPT) -> DataFrame:
    """``doc_id, row, pos, first_doc`` of every line whose template recurs in ``min_docs`` documents or more, once, however often a row is repeated."""
    lines = lines_of(docs, id_col, text_col)
    long_enough = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) >= min_tokens - 1
    leafed = lines.where(F.col("doc_id").isNotNull() & (F.col("line") != "") & long_enough).select("doc_id", "row", "pos", "line", _leaf(F.col("line"), depth).alias("leaf"))
    crowded = leafed.select("leaf", "doc_id").groupBy("leaf", "doc_id").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf")
    tokens = F.split("line", " ")
    masked = F.when(F.col("line").rlike("[0-9]"), F.array_join(_masked(tokens), " ")).otherwise(F.col("line"))
    kept = leafed.join(_small(materialise(crowded, "leaves")), "leaf").select("doc_id", "row", "pos", "leaf", "line", masked.alias("masked"))
    firm = (F.col("line") == F.col("masked")) | (F.size(F.filter(F.split("masked", " "), lambda t: t != FIELD)) >= min_kept * F.size(tokens))
    kept = kept.select("doc_id", "row", "pos", "leaf", firm.alias("firm"), F.when(firm, F.col("masked")).otherwise(F.col("line")).alias("line"))
    kept = materialise(kept.select("*", F.xxhash64("firm", "line").alias("k1"), F.xxhash64(F.lit(1), "line", "firm").alias("k2")), "crowded-lines")
    own = ["k1", "k2"]
    in_doc = kept.groupBy("leaf", "firm", *own, "doc_id").agg(F.lit(1).alias("one"))
    distinct = materialise(in_doc.groupBy("leaf", "firm", *own).agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("doc_id")), "distinct-lines")
    # each distinct line once, from its first document, token by token
    shown = kept.select(*own, "doc_id", "line").join(distinct.where("firm").drop("firm"), [*own, "doc_id"]).dropDuplicates([*own, "doc_id"])
    # outer, or the optimiser infers a filter on the array and splits every line twice
    each = shown.select("leaf", *own, "docs", F.posexplode_outer(F.split("line", " ")).alias("at", "token"))
    each = materialise(each.select("leaf", *own, "docs", "at", F.xxhash64("token").alias("token"), (F.col("token") == FIELD).alias("field")), "tokens")
    # written first, as every table below that joins a hot leaf or line: a join with the bare aggregate could not be split
    common = each.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("leaf", "at", "token", F.lit(True).alias("common"))
    common = _small(materialise(common, "common-tokens"))
    # a line that recurs as it stands keeps all its tokens; the others are generalised within their leaf
    stays = ~F.col("field") & ((F.col("docs") >= min_docs) | F.coalesce("common", F.lit(False)))
    told = each.join(common, ["leaf", "at", "token"], "left").withColumn("stays", stays)
    place = [F.col("at"), F.when(F.col("stays"), F.col("token")), F.col("stays")]
    shapes = told.groupBy("leaf", *own).agg(F.bit_xor(F.xxhash64(*place)).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), *place)).alias("s2"), F.avg(F.col("stays").cast("double")).alias("share"))
    general = shapes.where(F.col("share") >= min_kept).select(*own, F.xxhash64("leaf", "s1").alias("t1"), F.xxhash64("s2", "leaf").alias("t2"))
    exact = distinct.where(~F.col("firm") & (F.col("docs") >= min_docs)).select(*own, F.col("k1").alias("t1"), F.col("k2").alias("t2"))
    templates = _small(materialise(general.unionByName(exact), "templates"))
    placed = materialise(kept.select("doc_id", "row", "pos", *own).join(templates, own).select("doc_id", "row", "pos", "t1", "t2"), "placed")
    often = placed.groupBy("t1", "t2", "doc_id").agg(F.lit(1).alias("one")).groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") >= min_docs)
    often = _small(materialise(often.drop("n"), "recurring"))
    return placed.join(often, ["t1", "t2"]).select("doc_id", "row", "pos", "first_doc").distinct()


def _thinned(docs: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    gone = recurring(docs, id_col, text_col, **how).where("doc_id <> first_doc").groupBy(F.col("doc_id").alias("__pw_id"), F.col("row").alias("__pw_row")).agg(F.collect_set("pos").alias("__pw_gone"))
    gone = materialise(gone, "dropped")
    lines = gone.agg(F.sum(F.size("__pw_gone"))).first()[0] or 0
    gone = F.broadcast(gone) if lines <= BROADCAST_ROWS else gone.hint("merge")
    text = F.col(f"`{text_col}`").cast("string")
    joined = docs.join(gone, (F.col(f"`{id_col}`").cast("long") == F.col("__pw_id")) & (F.xxhash64(text) == F.col("__pw_row")), "left").withColumn("__pw_lines", F.split(text, "\n"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("__pw_lines") - 1), "__pw_gone")
    kept = F.array_join(F.transform(stays, lambda i: F.get("__pw_lines", i)), "\n")
    return joined.withColumn("__pw_text", F.when(F.col("__pw_gone").isNull(), text).otherwise(kept))


def without_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with its columns as they are, but for the text, which has lost its dropped lines.

    A line that recurs stays in the document of the smallest id. Null texts stay null and empty ones empty; a document of
    which nothing stays has an empty text. Lines of documents without an id neither count nor go. Rows of one id are one
    document, whatever their texts; repeated rows change nothing and lose the same lines. Blank lines and lines of fewer
    than three tokens stay. An empty table gives none; other columns stay as they are.
    """
    thinned = _thinned(docs, id_col, text_col, **how)
    return thinned.select(*(thinned["__pw_text"].alias(text_col) if c == text_col else thinned[f"`{c}`"] for c in docs.columns))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, text`` (what stays of it; the rules are those of without_recurring)."""
    thinned = _thinned(docs, id_col, text_col, **how)
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return thinned.select(F.col(id_col).cast("long").alias("doc_id"), count("__pw_lines").alias("n_lines"), count("__pw_gone").alias("n_dropped"), F.col("__pw_text").alias("text"))
