"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are hashed byte trigrams of the text itself, of its shape
(letters and digits replaced by their class) and of the pattern in which
neighbouring words repeat. A bounded, documented sample of
labelled texts fits the term weights and a truncated singular value
decomposition; its latent vectors are broadcast, and every document is compared
with all of them, block by block, by exact cosine. The nearest vote with their
similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.llm._shared import mapped

#: Bounds of the fit: labelled texts, hashed terms of each kind, latent dimensions.
MAX_LABELLED, TERMS, REPEAT_TERMS, RANK = 2000, 1024, 16, 32
NEIGHBOURS, THRESHOLD, SEED = 15, 0.3, 6
_BLOCK = 256

_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else 48 if 48 <= b <= 57 else b for b in range(256))


def trigram_counts(data: bytes, terms: int) -> np.ndarray:
    """How often each of ``terms`` (a power of two) hashed byte trigrams occurs in the whole of ``data``."""
    out = np.zeros(terms)
    shift = np.uint32(32 - terms.bit_length() + 1)
    for at in range(0, max(0, len(data) - 2), 1 << 20):
        b = np.frombuffer(data, np.uint8, min(len(data) - at, (1 << 20) + 2), at).astype(np.uint32)
        gram = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        out += np.bincount((gram * np.uint32(2654435761)) >> shift, minlength=terms)
    return out


def _repeats(data: bytes) -> bytes:
    """One letter for each pair of neighbouring words: whether they are the same."""
    words = data.split()
    return b"".join([b"s" if a == b else b"d" for a, b in pairwise(words)])


def terms_of(texts: list[str | None], terms: int = TERMS) -> np.ndarray:
    """Dampened term counts of whole texts, at length one for each kind of term; a null, empty or very short text has none."""
    sizes = (terms, terms, REPEAT_TERMS)
    out = np.zeros((len(texts), sum(sizes)), np.float32)
    for i, text in enumerate(texts):
        data, at = (text or "").encode("utf-8", "surrogatepass"), 0
        for n, x in zip(sizes, (data, data.translate(_SHAPE), _repeats(data)), strict=True):
            counts = np.sqrt(trigram_counts(x, n))
            norm = np.sqrt((counts * counts).sum())
            if norm:
                out[i, at : at + n] = counts / norm
            at += n
    return out


def fit(terms: np.ndarray, labels: np.ndarray, rank: int = RANK, seed: int = SEED) -> dict:
    """Term weights, projection, latent vectors of the labelled texts and their labels."""
    known = (terms > 0).sum(axis=0)
    weights = np.log((1 + len(terms)) / (1 + known)).astype(np.float32) + np.float32(0.1)
    x = terms * weights
    rank = min(rank, *x.shape) if len(x) else 0
    if not rank:
        return {"weights": weights, "basis": np.zeros((terms.shape[1], 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "labels": np.zeros(0), "prior": 0.5}
    q = np.random.default_rng(seed).standard_normal((x.shape[1], rank + 8)).astype(np.float32)
    for _ in range(4):  # randomised range finder with power iterations
        q, _ = np.linalg.qr(x @ q)
        q, _ = np.linalg.qr(x.T @ q)
    _, _, rows = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ rows[:rank].T).astype(np.float32)
    return {"weights": weights, "basis": basis, "vectors": _unit(x @ basis), "labels": labels.astype(np.float64), "prior": float(labels.mean())}


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def vote(model: dict, terms: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores: the share of label 1 among the nearest labelled vectors, weighted by cosine; the base rate where nothing is similar."""
    near = _unit((terms * model["weights"]) @ model["basis"]) @ model["vectors"].T
    if not near.shape[1]:
        return np.full(len(terms), model["prior"])
    k = min(neighbours, near.shape[1])
    last = np.partition(near, -k, axis=1)[:, -k, None]
    nearer, even = near > last, near == last
    voters = nearer | (even & (np.cumsum(even, axis=1) <= k - nearer.sum(axis=1, keepdims=True)))  # of those even at the last place, the first
    weight = np.where(voters, np.maximum(near, 0), 0).astype(np.float64)
    total = weight.sum(axis=1)
    return np.divide(weight @ model["labels"], total, out=np.full(len(terms), model["prior"]), where=total > 1e-9)


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Terms and labels of at most ``bound`` training documents: of the labelled ids outside the held-out fold, those of least hash.

    Labels other than 0 and 1, null labels and ids with both labels teach nothing. Of several texts of an id, that of least
    hash teaches, however often rows are repeated.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    ids = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(bound).select("doc_id", F.col("quality").cast("int").alias("quality"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    taught = plain.join(F.broadcast(ids), "doc_id")  # at most `bound` ids
    taught = taught.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _BLOCK):
                batch = whole.slice(at, _BLOCK)
                found = terms_of(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([x.astype(np.float16).tobytes() for x in found], pa.binary())], ["doc_id", "quality", "terms"])

    got = sorted(((r.doc_id, r.quality, bytes(r.terms)) for r in mapped(taught, run, "doc_id long, quality int, terms binary").collect()))
    x = np.array([np.frombuffer(t, np.float16) for _, _, t in got], np.float32).reshape(len(got), 2 * TERMS + REPEAT_TERMS)
    return x, np.array([q for _, q, _ in got], np.int64)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Null, empty and very short texts have no terms and score the base rate of label 1 (0.5 if nothing is labelled). Repeated
    rows score alike. A null id is in no fold (held_out false) and never teaches. Columns other than the id and text of
    ``docs`` and the id and quality of ``labels`` are not read.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = plain.sparkSession.sparkContext.broadcast(fit(*labelled_sample(plain, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _BLOCK):
                batch = whole.slice(at, _BLOCK)
                score = vote(model.value, terms_of(batch.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(score, 0, 1))], ["doc_id", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return mapped(plain, run, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more, with all their columns; each row is judged by its own text."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(*labelled_sample(plain, labels)))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _BLOCK):
                batch = whole.slice(at, _BLOCK)
                score = vote(model.value, terms_of(batch.column(text).to_pylist()))
                yield batch.filter(pa.array(score >= threshold))

    return mapped(docs, run, docs.schema)
