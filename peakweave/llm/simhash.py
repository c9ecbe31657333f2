"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits: bit b is set if more than half of the XXH64 values
of the text's shingles have it set. Two fingerprints that differ in at most r
bits agree in at least ``blocks - r`` of ``blocks`` blocks; each choice of so
many blocks is a key of a table, so a close pair meets in at least one table.
Pairs that meet are verified by their Hamming distance.

Documents of one fingerprint count as one. Links leave a bucket as stars, never
as all pairs, and a hot bucket is compared tile by tile.

``similar_documents`` takes these close pairs, verifies them by the exact
similarity of their shingles, and then finds those similar pairs that lie
further apart: they share one of the rarest shingles of their sets, and wide
fingerprints spare comparisons in crowded buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakweave.llm._shared import fits, mapped, materialise
from peakweave.llm.components import connected_components
from peakweave.llm.tiles import map_tiles, runs, stars, tiled

SHINGLE, RADIUS, BLOCKS, SEED = 3, 3, 5, 42
WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: Sets of a similarity of 0.8 differ in about 19 of 128 bits (4 more or less), whatever their size, and unlike ones in 64: no pair so far apart is looked at.
WIDE_RADIUS = 44
#: Shingles of more sets than this come last in the order of shingles, and buckets of more sets are compared by sketches. It changes how sets are compared, not what is found.
COMMON = 64
#: So many of the commonest shingles are told apart from the rare (16 bytes each, broadcast), and in a stretch of rows those of so many sets are counted.
MOST_COMMON, SEEN, _STRETCH = 500_000, 3, 1 << 22
#: So many of the least hashes of a set are its sketch, which is all of it for texts of a few hundred words.
SKETCH = 512
_COLUMNS = 4096
#: Sets, or shingles, of a table that is broadcast (8 to 40 bytes each).
BROADCAST_ROWS, SHARED_ROWS = 500_000, 20_000
_SLICE = 1 << 15
_SMALL = 48
_ROWS = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text, unsigned; zero if it is null or has no word.

    A-Z count as a-z, words end at ASCII white space, and a text of fewer words than a shingle is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        n = len(words) - shingle + 1
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _SLICE):
        part = h[i : i + _SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` for each row, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(kept, run, "doc_id long, fp long")


def _keys(fp, radius: int, blocks: int) -> list:
    """One key for each choice of blocks in which a close pair may agree."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)) for k in range(blocks)]
    chosen = combinations(range(blocks), blocks - radius)
    return [F.struct(F.lit(t).alias("t"), F.xxhash64(*(parts[k] for k in c)).alias("key")) for t, c in enumerate(chosen)]


def _close(radius: int):
    def work(rows: pa.Table) -> pa.Table | None:
        tile, rep, fp = rows["tile"].to_numpy(), rows["rep"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)

        def near(i, j) -> np.ndarray:
            return np.bitwise_count(fp[i] ^ fp[j]) <= radius

        starts, sizes = runs(tile)
        a, b = [], []
        run_of = np.repeat(np.arange(len(starts)), sizes)
        small = sizes[run_of] <= _SMALL
        for k in range(1, min(_SMALL, int(sizes.max(initial=1)))):
            i = np.flatnonzero(small[:-k] & (run_of[:-k] == run_of[k:]))
            i = i[near(i, i + k)]
            a.append(rep[i])
            b.append(rep[i + k])
        for s, n in zip(starts[sizes > _SMALL], sizes[sizes > _SMALL], strict=True):
            linked, own = np.empty((n, n), bool), np.arange(s, s + n)
            for i in range(0, n, 256):
                linked[i : i + 256] = near(own[i : i + 256, None], own[None, :])
            root, other = stars(linked)
            a.append(rep[s + root])
            b.append(rep[s + other])
        if not a or not sum(map(len, a)):
            return None
        pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b))), axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return work


def near_links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``(a, b)`` links among rows ``(rep, fp)`` of different fingerprints, with the components of all close pairs."""
    rows = prints.select("rep", "fp", F.inline(F.array(*_keys(F.col("fp"), radius, blocks))))
    return map_tiles(tiled(rows, ["t", "key"], "rep"), _close(radius), "a long, b long", ["rep"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id`` (the smallest doc_id reachable by links).

    Null and empty texts have fingerprint zero and link like any other; repeated rows stay; an empty table gives none;
    other columns of ``docs`` are not read, whatever their names. A null id keeps its row and, alone in its group, a null component.
    """
    if not 0 < radius < blocks:
        raise ValueError("a pigeonhole needs more blocks than bits of radius")
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    groups = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "groups")
    found = connected_components(near_links(groups.where("rep IS NOT NULL"), radius, blocks), "a", "b")
    classes = groups.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, shingle: int = WIDE_SHINGLE) -> tuple[np.ndarray, int, int]:
    """The distinct shingles of a whole text, by the rules of ``fingerprint``, as sorted 64-bit hashes, and the set's 128-bit fingerprint as two longs."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64), 0, 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)]
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, grams)), "<i8").reshape(-1, 2)
    hashes, at = np.unique(digests[:, 0], return_index=True)
    ones = np.zeros(128, np.int64)
    for i in range(0, len(at), _SLICE):
        part = digests[at[i : i + _SLICE]].view(np.uint8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    low, high = np.packbits(2 * ones > len(at)).view("<i8")
    return hashes, int(low), int(high)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, row, text``; row is a hash of the text."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def _own(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def shingle_prints(texts: DataFrame, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """``(doc_id, row, own, n, lo, hi, fp)`` for each row: a hash of its set, the set's size and fingerprint, and the text's ``fingerprint``.

    Further rows, of null ``n``, tell how many sets of a stretch of rows hold a shingle, ``(own, seen)``, where they are
    ``SEEN`` or more; these sums are a lower bound of what is common.
    """

    def told(sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens, times = np.unique(np.concatenate(sets), return_counts=True)
        often = times >= SEEN
        none = pa.nulls(int(often.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(tokens[often]), none, none, none, none, pa.array(times[often])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            rows: list[tuple] = []
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                hashes, low, high = shingle_set(text.as_py(), shingle)
                own = _own(hashes)
                close = int(np.uint64(fingerprint(text.as_py())).view(np.int64))
                rows.append((doc, row, own, len(hashes), low, high, close, None))
                if own not in sets:
                    sets[own] = hashes
                    held += len(hashes)
                if held > _STRETCH:
                    yield told(list(sets.values()))
                    sets, held = {}, 0
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names) if rows else pa.RecordBatch.from_arrays([pa.nulls(0, pa.int64())] * 8, names)
        if sets:
            yield told(list(sets.values()))

    names = ["doc_id", "row", "own", "n", "lo", "hi", "fp", "seen"]
    return mapped(texts, run, ", ".join(f"{c} long" for c in names))


def _sets_of(texts: DataFrame, wanted: DataFrame, shingle: int, most: int | None = None) -> DataFrame:
    """``own, shingles`` of the sets ``(own, rep, row)``, from the texts of their representatives; the ``most`` least hashes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                found = [shingle_set(x.as_py(), shingle)[0][:most] for x in batch.column(1)]
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))], ["own", "shingles"])

    rows = texts.withColumnRenamed("doc_id", "rep").join(_small(wanted), ["rep", "row"]).select("own", "text")
    return mapped(rows, run, "own long, shingles array<long>").dropDuplicates(["own"])


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if fits(df, rows) else df


def _prefix_length(n: int, similarity: float) -> int:
    """Two similar sets, in one order, have one of so many first shingles in common."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _prefix_keys(texts: DataFrame, reps: DataFrame, common: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``(own, key)``: the prefix of each set, rarest shingles first. reps: ``own, rep, row``; common: ``key, n``.

    Shingles that are not in ``common`` count as rare, in every set alike, and stand in the order of their hashes.
    """
    found = common.select("key", "n").toArrow().sort_by("key")  # no more than MOST_COMMON
    sent = texts.sparkSession.sparkContext.broadcast((found["key"].to_numpy(), found["n"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                found = []
                for text in part.column(1):
                    hashes = shingle_set(text.as_py(), shingle)[0]
                    if len(known):
                        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                        hashes = hashes[np.argsort(np.where(known[place] == hashes, times[place], 0), kind="stable")]
                    found.append(hashes[: _prefix_length(len(hashes), similarity)])
                own = np.repeat(part.column(0).to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate(found))], ["own", "key"])

    rows = texts.withColumnRenamed("doc_id", "rep").join(_small(reps), ["rep", "row"]).select("own", "text")
    return mapped(rows, run, "own long, key long")


def _candidates(similarity: float):
    """Pairs of a tile, of different components, that by size and fingerprint can be similar."""

    def work(rows: pa.Table) -> pa.Table | None:
        tile, own, n, of = (rows[c].to_numpy() for c in ("tile", "own", "n", "component"))
        low, high = (rows[c].to_numpy().view(np.uint64) for c in ("lo", "hi"))

        def near(i, j) -> np.ndarray:
            apart = np.bitwise_count(low[i] ^ low[j]) + np.bitwise_count(high[i] ^ high[j])
            return (of[i] != of[j]) & (apart <= WIDE_RADIUS) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)

        starts, sizes = runs(tile)
        a, b = [], []
        run_of = np.repeat(np.arange(len(starts)), sizes)
        small = sizes[run_of] <= _SMALL
        for k in range(1, min(_SMALL, int(sizes.max(initial=1)))):
            i = np.flatnonzero(small[:-k] & (run_of[:-k] == run_of[k:]))
            i = i[near(i, i + k)]
            a.append(i)
            b.append(i + k)
        for s, m in zip(starts[sizes > _SMALL], sizes[sizes > _SMALL], strict=True):
            for i in range(s, s + m, 256):
                block, others = np.arange(i, min(i + 256, s + m)), np.arange(i, s + m)
                x, y = np.nonzero(near(block[:, None], others[None, :]) & (block[:, None] < others[None, :]))
                a.append(block[x])
                b.append(others[y])
        if not a or not sum(map(len, a)):
            return None
        x, y = own[np.concatenate(a)], own[np.concatenate(b)]
        pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y))), axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return work


def _sketched(similarity: float):
    """Of a tile's sets of different components, those linked: surely, as stars, where the sketches are the whole sets; else pairs that the sketches allow by five standard deviations."""

    def work(rows: pa.Table) -> pa.Table | None:
        starts, sizes = runs(rows["tile"].to_numpy())
        own, n, of, low, high = (rows[c].to_numpy() for c in ("own", "n", "component", "lo", "hi"))
        low, high, sketch = low.view(np.uint64), high.view(np.uint64), rows["sketch"]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for s, m in zip(starts, sizes, strict=True):
            maybe = np.zeros((m, m), bool)
            rest = np.arange(s, s + m)
            for i in range(0, m, 256):
                at = np.arange(s + i, s + min(i + 256, m))[:, None]
                apart = np.bitwise_count(low[at] ^ low[rest]) + np.bitwise_count(high[at] ^ high[rest])
                maybe[i : i + 256] = (of[at] != of[rest]) & (apart <= WIDE_RADIUS) & (np.minimum(n[at], n[rest]) >= similarity * np.maximum(n[at], n[rest]) - 1e-9)
            some = np.flatnonzero(maybe.any(axis=1))
            if not len(some):
                continue
            maybe, ids, total = maybe[np.ix_(some, some)], own[s + some], n[s + some]
            lists = [sketch[int(s + k)].values.to_numpy() for k in some]
            sizes_ = np.array([len(x) for x in lists])
            end = np.where(total > sizes_, np.array([x[-1] for x in lists]), np.iinfo(np.int64).max)  # up to here the sketch is whole
            tokens, place, often = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
            name = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[place]
            member, kept = np.repeat(np.arange(len(some)), sizes_), name >= 0
            member, name = member[kept], name[kept]
            same = np.zeros((len(some), len(some)), np.float32)
            order = np.argsort(name, kind="stable")
            member, name = member[order], name[order]
            for column in range(0, int(name[-1]) + 1 if len(name) else 0, _COLUMNS):
                a, b = np.searchsorted(name, (column, column + _COLUMNS))
                part = np.zeros((len(some), _COLUMNS), np.float32)
                part[member[a:b], name[a:b] - column] = 1
                same += part @ part.T
            upto = np.stack([np.searchsorted(x, np.minimum(own_end, end), side="right") for x, own_end in zip(lists, end, strict=True)])
            union = upto + upto.T - same
            whole = (total <= sizes_)[:, None] & (total <= sizes_)
            least = np.where(whole, similarity - 1e-9, similarity - 5 * np.sqrt(similarity * (1 - similarity) / np.maximum(union, 1)))
            maybe &= same >= least * union
            root, other = stars(maybe & whole)
            found.append((ids[root], ids[other], np.ones(len(root), bool)))
            x, y = np.nonzero(np.triu(maybe & ~whole))
            found.append((ids[x], ids[y], np.zeros(len(x), bool)))
        if not found:
            return None
        a, b, sure = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "sure": sure})

    return work


def _close_sets(prints: DataFrame) -> DataFrame:
    """``(a, b)``: sets of texts whose fingerprints are equal or, by the tables of blocks, close. prints: ``own, fp``; one set can have several.

    Texts of one fingerprint and hot buckets give stars, so that a close pair is here or joined by others.
    """
    fps = prints.select("own", "fp").distinct()
    groups = materialise(fps.groupBy("fp").agg(F.min("own").alias("rep")), "fingerprints")
    equal = fps.join(groups, "fp").select(F.col("own").alias("a"), F.col("rep").alias("b"))
    found = near_links(groups).unionByName(equal).where("a <> b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _similar(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Of distinct pairs ``(a, b)`` of sets with ``rep_`` and ``row_`` of each, those of enough similarity, by the sets themselves."""
    sides = [pairs.select(F.col(x).alias("own"), F.col(f"rep_{x}").alias("rep"), F.col(f"row_{x}").alias("row")) for x in ("a", "b")]
    wanted = materialise(sides[0].unionByName(sides[1]).distinct(), "wanted-sets")
    sets = materialise(_sets_of(texts, wanted, shingle), "compared-sets")
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    same = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(same / (F.size("set_a") + F.size("set_b") - same) >= similarity).select("rep_a", "rep_b")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: ``doc_id, row, component_id`` (row is a hash of its text), linked by a similarity (common shingles by all, repeats aside) of at least ``similarity``.

    A first round compares the pairs whose SimHash fingerprints are close. Not every similar pair is, but every one shares
    a shingle of the prefixes of its sets, so the first round also compares each set of such a bucket with one of them,
    another for each bucket. What it links is not compared again when a second round compares the rest: pair by pair in
    small buckets, in large ones by sketches, tile by tile, so that a large family gives links but not pairs. Every link is
    verified by the sets. Rules as in near_duplicates.
    """
    if not 0 < similarity <= 1:
        raise ValueError("a similarity lies between 0 and 1")
    texts = _texts(docs, id_col, text_col)
    found = materialise(shingle_prints(texts, shingle), "prints")
    prints = found.where("n IS NOT NULL")
    first = [F.first(c).alias(c) for c in ("n", "lo", "hi")]
    groups = prints.groupBy("own").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("r"), *first)
    named = materialise(groups.where("r IS NOT NULL").select("own", F.col("r.doc_id").alias("rep"), "r.row", "n", "lo", "hi"), "sets")
    common = found.where("seen IS NOT NULL").groupBy(F.col("own").alias("key")).agg(F.sum("seen").alias("n")).where(F.col("n") > COMMON)
    common = materialise(common.orderBy(F.desc("n"), "key").limit(MOST_COMMON), "common-shingles")
    keys = _prefix_keys(texts, named.select("own", "rep", "row"), common, similarity, shingle)
    often = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("sharing")).where("sharing > 1"), "shared-keys")
    met = materialise(keys.join(_small(often, SHARED_ROWS), "key").select("key", "own", "sharing").distinct(), "shared-shingles")
    least = materialise(met.groupBy("key").agg(F.min(F.col("own").bitwiseXOR(F.col("key"))).alias("least")), "hubs")
    shared = met.join(_small(least), "key").select("key", "own", "sharing", F.col("least").bitwiseXOR(F.col("key")).alias("hub"))
    about = named.select("own", "rep", "row", "n", "lo", "hi")

    def with_both(pairs: DataFrame) -> DataFrame:
        return pairs.join(about.toDF("a", "rep_a", "row_a", "n_a", "lo_a", "hi_a"), "a").join(about.toDF("b", "rep_b", "row_b", "n_b", "lo_b", "hi_b"), "b")

    ends = ["a", "b", "rep_a", "rep_b", "row_a", "row_b"]
    hubs = shared.where("own <> hub").select(F.least("own", "hub").alias("a"), F.greatest("own", "hub").alias("b")).distinct()
    apart = F.bit_count(F.col("lo_a").bitwiseXOR(F.col("lo_b"))) + F.bit_count(F.col("hi_a").bitwiseXOR(F.col("hi_b")))
    alike = (apart <= WIDE_RADIUS) & (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9)
    close = _close_sets(prints.where("doc_id IS NOT NULL"))
    pairs = materialise(with_both(hubs.unionByName(close).distinct()).where(alike).select(ends), "pairs")
    found = connected_components(_similar(pairs, texts, similarity, shingle), "rep_a", "rep_b")

    rows = shared.where("sharing > 2").join(about, "own").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    rows = materialise(rows.select("key", "own", "sharing", "n", "lo", "hi", "rep", "row", F.coalesce("component", "rep").alias("component")), "rows")
    differ = F.min("component") < F.max("component")
    few = tiled(rows.where(F.col("sharing") <= COMMON).drop("sharing", "rep", "row"), ["key"], "own", worth=differ)
    rest = map_tiles(few, _candidates(similarity), "a long, b long", ["own"])
    crowded = rows.where(F.col("sharing") > COMMON).drop("sharing")
    worth = materialise(crowded.groupBy("key").agg(differ.alias("differ")).where("differ").select("key"), "mixed-buckets")
    crowded = crowded.join(_small(worth), "key")
    sketches = _sets_of(texts, materialise(crowded.select("own", "rep", "row").distinct(), "crowded-sets"), shingle, SKETCH).withColumnRenamed("shingles", "sketch")
    many = tiled(crowded.drop("rep", "row"), ["key"], "own", prune=False).join(materialise(sketches, "sketches"), "own")
    told = materialise(map_tiles(many, _sketched(similarity), "a long, b long, sure boolean", ["own"]).distinct(), "sketched")
    rest = rest.unionByName(told.where("NOT sure").select("a", "b")).distinct()
    pairs = materialise(with_both(rest).select(ends), "pairs")
    links = found.toDF("rep_a", "rep_b").unionByName(_similar(pairs, texts, similarity, shingle)).unionByName(with_both(told.where("sure")).select("rep_a", "rep_b"))
    found = connected_components(links, "rep_a", "rep_b")
    classes = named.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("own", F.coalesce("component", "rep").alias("component_id"))
    return prints.select("doc_id", "row", "own").join(classes, "own", "left").select("doc_id", "row", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that are similar, directly or by others, to one of a smaller id.

    All columns stay. Rows are told apart by id and text: repeated rows of a kept one stay, one text of an id may go while
    another stays, and rows without an id stay. Null, empty and blank texts are copies of one another.
    """
    gone = similar_documents(docs, id_col, text_col, **how).where("doc_id <> component_id").select(F.col("doc_id").alias("__pw_id"), F.col("row").alias("__pw_row")).distinct()
    gone = _small(materialise(gone, "copies"))
    same = (docs[f"`{id_col}`"].cast("long") == F.col("__pw_id")) & (F.xxhash64(docs[f"`{text_col}`"].cast("string")) == F.col("__pw_row"))
    return docs.join(gone, same, "left_anti")
