"""Packing of tokenised documents into sequences by Karmarkar-Karp differencing.

A document's ids are cut into full sequences and a rest; the rest is cut into
chunks and ever smaller halves, so that windows level out. They are dealt into groups of
about a fixed number of tokens, and each group is packed alone: multiway
differencing merges the two partial partitions with the largest imbalances,
largest sums against smallest, until one partition is left, whose windows have
nearly equal sums. If one exceeds the capacity, the window count rises by one
and the group is differenced again.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from peakweave.llm._shared import mapped, materialise
from peakweave.sources.shipping import ship

CAPACITY, CHUNK, LEAST, GROUP_TOKENS, EOD = 1024, 128, 8, 196_608, 0

_first = itemgetter(0)

#: Fixed value: how the vocabulary's pre-tokenizer splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranked_by_id(model: dict, added: list[str]) -> bool:
    """Whether ids grow in the order of merges, so that an id can stand for the rank of the merge that makes it, and every byte has one."""
    made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    single = [model["vocab"].get(c) for c in byte_symbols()]
    rest = len(model["vocab"]) - sum(x in model["vocab"] for x in added)
    known = None not in made and None not in single
    return known and all(a < b for a, b in zip(made, made[1:], strict=False)) and max(single) < min(made, default=1 << 40) and rest == len(made) + len(single)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A function from texts to arrays of ids, as the tokenizer file at ``path`` gives without special tokens added.

    The merges of a plain byte-level file, in order of rank, run in tiktoken, which is several times as fast. Texts that
    hold one of the file's added tokens, and all texts for any other kind of file, go to the tokenizer itself.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    own = Tokenizer.from_file(path)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not model.get("dropout") and spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain:
        return lambda text: np.asarray(own.encode(text, add_special_tokens=False).ids, "<u4")
    symbols = byte_symbols()
    added = [x["content"] for x in spec.get("added_tokens", ())]
    if not _ranked_by_id(model, added):
        return lambda text: np.asarray(own.encode(text, add_special_tokens=False).ids, "<u4")
    ranks = {bytes(symbols[c] for c in token): rank for token, rank in model["vocab"].items() if token not in added}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if any(x in text for x in added):
            return np.asarray(own.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(fast.encode_ordinary(text), "<u4")

    return ids


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(length: int, capacity: int = CAPACITY, chunk: int = CHUNK, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full sequences, then chunks, then halves of what is left down to ``least``.

    The many small pieces are what lets differencing level windows out to the last id.
    """
    lengths = [capacity] * (length // capacity)
    rest = length % capacity
    while rest > least:
        lengths.append(chunk if rest > chunk else (rest + 1) // 2)
        rest -= lengths[-1]
    if rest:
        lengths.append(rest)
    return list(zip(accumulate([0, *lengths[:-1]]), lengths, strict=True)) if lengths else []


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of every piece; a null text counts as empty and has the closing id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.array([EOD], "<u4")).astype("<u4")
                n = len(ids)
                out += [(doc, s, k, zlib.crc32(ids[s : s + k]), n) for s, k in cut(n, capacity, chunk)]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(kept, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: indexes of ``sizes`` in each of ``windows`` windows of near-equal sums.

    A partial partition lists its windows, largest first, as (sum above its least window, members); windows that it
    doesn't list are empty and stand at the least.
    """
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    for count in range(len(sizes), 2 * len(sizes) - 1):
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        shared = max(0, len(a) + len(b) - windows)  # so many windows get members of both: a's least with b's least, in opposite order
        keep = len(a) - shared
        joined = [(x + y, m + n) for (x, m), (y, n) in zip(a[keep:], reversed(b), strict=False)]
        merged = a[:keep] + b[: len(b) - shared] + joined
        merged.sort(key=_first, reverse=True)
        if len(merged) == windows and (least := merged[-1][0]):
            merged = [(x - least, m) for x, m in merged]
        heapq.heappush(heap, (-merged[0][0] if len(merged) < windows else merged[-1][0] - merged[0][0], count, merged))
    return [m for _, m in heap[0][2]] if heap else []


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``, as few as differencing reaches; each size is at most the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, windows)
        if max((sum(sizes[i] for i in w) for w in found), default=0) <= capacity:
            return [w for w in found if w]
        windows += 1


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, chunk: int = CHUNK, group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every id of a document, the closing id included, lies in exactly one piece, and every piece in one sequence of at most
    ``capacity`` ids, gapless from offset 0. Null and empty texts have one piece of one id; repeated rows give repeated
    pieces; an empty table gives none. Other columns are not read.
    """
    found = materialise(pieces(docs, path or default_tokenizer(), capacity, chunk, id_col, text_col), "pieces")
    full = found.where(F.col("length") == capacity)
    rest = found.where(F.col("length") < capacity)
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(tokens / group_tokens))
    # neither a very long document nor repeated rows fill a group alone: pieces are dealt by their place in the written table too
    dealt = rest.withColumn("group_id", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def work(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        sizes = table["length"].to_pylist()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for w, members in enumerate(pack(sizes, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = w, at
                at += sizes[i]
        sequence += key[0].as_py() << 24
        return table.drop_columns(["group_id"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    ship(docs.sparkSession)
    small = dealt.groupBy("group_id").applyInArrow(work, schema)
    # a full piece is a sequence by itself; its number is below zero and tells its part of the table and place there
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return small.unionByName(alone)
