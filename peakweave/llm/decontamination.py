"""Benchmark decontamination by SimHash over item-sized windows.

A window is as many words of a document as a benchmark item has. To be similar
to an item, most of its shingles must be the item's, in whatever order, so the
windows that count begin where enough of the item's shingles follow within the
item's length: one at each such shingle, and the document's last window. Any
other window can be moved right to one of these without losing a shingle in
common. Each of them gets a SimHash. Item fingerprints lie in a multi-index of
Hamming blocks: of ``blocks`` blocks at least one differs in at most
``radius // blocks`` bits, and each item is filed under every block value so
near, so that a window meets all items within the radius by looking its own
blocks up. Those are verified by the exact similarity of their shingles,
weighted by how often each occurs.

Everything is built-in column functions. Documents are never shuffled while few
of them hold such windows; their texts are told apart by a hash.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakweave.llm._shared import fits, materialise

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 20, 7
#: An index of at most so many rows is broadcast (each of a few dozen bytes); a larger one is joined by shuffle.
BROADCAST_ROWS = 400_000


def words_of(text: Column) -> Column:
    """Lower-cased words between white space; null and blank texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"\s+"), lambda w: w != "")


def hashes_of(words: Column, shingle: int = SHINGLE) -> Column:
    """A hash for each shingle; fewer words than a shingle are one shingle (which no longer text has), no words none."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(shingle))))
    return F.when(n >= shingle, each).when(n > 0, F.array(F.xxhash64(F.lit("whole"), F.array_join(words, " ")))).otherwise(F.expr("cast(array() as array<bigint>)"))


def simhash(hashes: str) -> Column:
    """64 bits of a column of hashes, each set if more than half of them have it set."""
    ones = f"aggregate({hashes}, 0L, (n, h) -> n + (shiftrightunsigned(h, b) & 1L))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (bits, b) -> bits | if(2 * {ones} > size({hashes}), shiftleft(1L, b), 0L))")


def _blocks(blocks: int) -> list[tuple[int, int]]:
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _block(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def _near(width: int, bits: int) -> list[int]:
    """Every mask of ``width`` bits of which at most ``bits`` are set."""
    return [sum(1 << b for b in chosen) for k in range(bits + 1) for chosen in combinations(range(width), k)]


def item_table(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``item_id, n`` (words), ``hashes, fp`` of the items that have a word."""
    words = benchmark.select(F.col(id_col).cast("long").alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    hashed = words.select("item_id", F.size("words").alias("n"), hashes_of(F.col("words"), shingle).alias("hashes"))
    return materialise(hashed.select("*", simhash("hashes").alias("fp")).distinct(), "items")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits(df, BROADCAST_ROWS) else df


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, row`` (a hash of the text) and the text."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def starts(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, row, n, start``: where windows of ``n`` words begin that hold as many of an item's shingles as similarity needs."""
    words = _rows(docs, id_col, text_col).select("doc_id", "row", words_of(F.col("text")).alias("words"))
    hashed = words.select("doc_id", "row", hashes_of(F.col("words"), shingle).alias("hashes"))
    anchors = items.select("item_id", "n", F.size("hashes").alias("m"), F.explode(F.array_distinct("hashes")).alias("h"))
    anchors = _small(materialise(anchors, "anchors"))
    # outer, or the optimiser infers a filter on the array and computes all of it again, words and all
    met = hashed.select("doc_id", "row", F.size("hashes").alias("size"), F.posexplode_outer("hashes").alias("pos", "h")).join(anchors, "h")
    wide = F.least("m", "size")
    need = F.ceil(similarity * (F.col("m") + wide) / (1 + similarity) - 1e-9).cast("int")  # so many in common make two bags of m and wide similar
    places = met.groupBy("doc_id", "row", "size", "item_id", "n", "m").agg(F.array_sort(F.collect_set("pos")).alias("at")).withColumn("need", need).where(F.size("at") >= F.col("need"))
    last = F.greatest(F.lit(0), F.col("size") - F.col("m"))
    dense = F.filter(F.transform("at", lambda p, k: F.when((p <= last) & (F.get("at", k + F.col("need") - 1) < p + F.col("m")), p)), lambda p: p.isNotNull())
    at_end = F.when(F.size(F.filter("at", lambda p: p >= last)) >= F.col("need"), F.array(last)).otherwise(F.expr("cast(array() as array<int>)"))
    return places.select("doc_id", "row", "n", F.explode(F.array_union(dense, at_end)).alias("start")).distinct()


def windows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The windows at ``starts``: ``doc_id, row, start, n, hashes, fp``, once, however often a row is repeated."""
    found = starts(docs, items, id_col, text_col, shingle, similarity).join(_small(items.select("n", F.size("hashes").alias("m")).distinct()), "n")
    found = materialise(found.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_list(F.struct("start", "n", "m")).alias("cuts")), "starts")
    rows = _rows(docs, id_col, text_col).join(_small(found), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")))
    words = rows.select("doc_id", "row", "cuts", words_of(F.col("text")).alias("words"))
    hashed = words.select("doc_id", "row", "cuts", hashes_of(F.col("words"), shingle).alias("hashes"))
    cut = hashed.select("doc_id", "row", "hashes", F.explode_outer("cuts").alias("c"))
    cut = cut.select("doc_id", "row", F.col("c.start").alias("start"), F.col("c.n").alias("n"), F.slice("hashes", F.col("c.start") + 1, F.col("c.m")).alias("hashes"))
    return materialise(cut.distinct().select("*", simhash("hashes").alias("fp")), "windows")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``doc_id, row, start, item_id, similarity`` for the windows that are similar to an item of their size; row is a hash of the text.

    start counts words from 0. Texts and items without a word have no windows; an item of fewer words than a shingle is
    found only where it is a whole text. Repeated rows give one leak; rows of one id are told apart by their texts.
    """
    items = item_table(benchmark, shingle=shingle)
    found = windows(docs, items, id_col, text_col, shingle, similarity)
    spans = _blocks(blocks)
    masks = F.array(*(F.array(*(F.lit(m).cast("long") for m in _near(w, radius // blocks))) for _, w in spans))
    own = F.array(*(_block(F.col("fp"), *span) for span in spans))
    filed = items.select("item_id", "n", F.col("fp").alias("item_fp"), F.size("hashes").alias("m"), F.posexplode(own).alias("block", "value"))
    filed = filed.withColumn("mask", F.explode(F.get(masks, F.col("block")))).select("item_id", "n", "item_fp", "m", "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    index = _small(materialise(filed, "index"))
    looked_up = found.select("doc_id", "row", "start", "n", "hashes", "fp", F.posexplode(own).alias("block", "value")).join(index, ["n", "block", "value"])
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.array_position(F.array(*(F.bit_count(_block(apart, *span)) <= radius // blocks for span in spans)), True) == F.col("block") + 1
    key = ["doc_id", "row", "start", "item_id"]
    near = looked_up.where(first & (F.bit_count(apart) <= radius)).select(*key, "m", "hashes")
    have = near.select(*key, "m", F.size("hashes").alias("w"), F.explode("hashes").alias("h")).groupBy(*key, "m", "w", "h").agg(F.count(F.lit(1)).alias("c"))
    wanted = items.select("item_id", F.explode("hashes").alias("h")).groupBy("item_id", "h").agg(F.count(F.lit(1)).alias("ci"))
    both = have.join(wanted, ["item_id", "h"]).groupBy(*key, "m", "w").agg(F.sum(F.least("c", "ci")).alias("same"))
    alike = F.col("same") / (F.col("m") + F.col("w") - F.col("same"))
    return both.select(*key, alike.alias("similarity")).where(F.col("similarity") >= similarity)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: ``doc_id, contaminated, n_items, item_id, similarity`` (the most similar item, the smaller id if even; else null).

    Each row is judged by its own text, repeated rows and those without an id too. Null, empty and blank texts are clean.
    Empty tables are fine on either side: no document, or no leak. Columns other than the id and the text are not read.
    """
    best = F.max(F.struct("similarity", (-F.col("item_id")).alias("less"))).alias("best")
    found = leaks(docs, benchmark, id_col, text_col, **how).groupBy(F.col("doc_id").alias("id"), F.col("row").alias("r")).agg(F.countDistinct("item_id").alias("n_items"), best)
    all_ = _rows(docs, id_col, text_col).select("doc_id", "row")
    out = all_.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("r")), "left")
    return out.select("doc_id", F.col("best").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), (-F.col("best.less")).alias("item_id"), F.col("best.similarity").alias("similarity"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows in whose text no item leaks, with all their columns; the rules are those of ``contamination``."""
    gone = leaks(docs, benchmark, id_col, text_col, **how).select(F.col("doc_id").alias("__pw_id"), F.col("row").alias("__pw_row")).distinct()
    gone = _small(materialise(gone, "contaminated"))
    same = docs[f"`{id_col}`"].cast("long").eqNullSafe(F.col("__pw_id")) & (F.xxhash64(docs[f"`{text_col}`"].cast("string")) == F.col("__pw_row"))
    return docs.join(gone, same, "left_anti")
