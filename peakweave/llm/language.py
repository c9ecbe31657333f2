"""Language identification by hierarchical discrimination.

Linear support vector machines first tell the families of the learned languages
apart, each against the rest, then, one against one, the languages of the
family that won. So there are as many machines as families and, in a family, as
pairs of its languages, however many languages are learned. A text is a
bag of hashed byte trigrams of its letters. Training takes a bounded sample of
each language; prediction reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.llm._shared import mapped
from peakweave.llm.quality import trigram_counts

#: Bounds of the fit: texts of a language, of all languages (but 50 of each at least), languages, hashed trigrams.
MAX_PER_LANGUAGE, MAX_TAUGHT, MAX_LANGUAGES, TERMS = 800, 16_000, 500, 4096
SEED = 7
_BLOCK = 256

#: Families of some written languages, by ISO 639-1 code; a language outside them is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], f"only {lang}")


def vectors(texts: list[str | None], terms: int = TERMS) -> np.ndarray:
    """Dampened trigram counts at length one, with a constant at the end."""
    out = np.zeros((len(texts), terms + 1), np.float32)
    out[:, -1] = 1
    for i, text in enumerate(texts):
        words = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split())
        counts = np.sqrt(trigram_counts(b" " + words + b" ", terms)) if words else np.zeros(terms)
        norm = np.sqrt((counts * counts).sum())
        if norm:
            out[i, :-1] = counts / norm
    return out


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> np.ndarray:
    """A linear support vector machine: squared hinge loss with classes of equal weight, by accelerated gradient steps. y: -1 or 1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = before = np.zeros(x.shape[1], np.float32)
    rate = 1 / (2 * 2 + penalty)  # rows have length sqrt(2) and the weights add up to one
    for step in range(steps):
        ahead = w + step / (step + 3) * (w - before)
        lost = np.maximum(0, 1 - y * (x @ ahead))
        before, w = w, ahead - rate * (penalty * ahead - 2 * x.T @ (weight * lost * y))
    return w


def one_against_one(x: np.ndarray, names: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Sorted class names, and a machine for each pair of them in order (the first is its positive side)."""
    classes = sorted(set(names))
    found = []
    for a, b in combinations(classes, 2):
        own = (names == a) | (names == b)
        found.append(svm(x[own], np.where(names[own] == a, 1, -1).astype(np.float32)))
    return classes, np.array(found, np.float32).reshape(len(found), x.shape[1])


def one_against_rest(x: np.ndarray, names: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Sorted class names, and a machine for each of them; a class alone needs none."""
    classes = sorted(set(names))
    found = [svm(x, np.where(names == c, 1, -1).astype(np.float32)) for c in classes if len(classes) > 1]
    return classes, np.array(found, np.float32).reshape(len(found), x.shape[1])


def fit(x: np.ndarray, langs: np.ndarray) -> dict:
    family = np.array([family_of(v) for v in langs], object)
    return {"families": one_against_rest(x, family), "languages": {f: one_against_one(x[family == f], langs[family == f]) for f in sorted(set(family))}}


def widest(classes: list[str], machines: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of the widest margin as an index (the first if even), and its share of a soft vote."""
    if len(classes) == 1:
        return np.zeros(len(x), int), np.ones(len(x))
    margin = (x @ machines.T).astype(np.float64)
    best = margin.argmax(axis=1)
    share = np.exp(4 * np.clip(margin - margin.max(axis=1, keepdims=True), -100, 0))
    return best, 1 / share.sum(axis=1)


def decide(classes: list[str], machines: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of the most won duels (by margin if even) as an index, and its share of a soft vote."""
    if len(classes) == 1:
        return np.zeros(len(x), int), np.ones(len(x))
    margin = np.clip(x @ machines.T, -6, 6).astype(np.float64)
    wins, soft, sums = (np.zeros((len(x), len(classes))) for _ in range(3))
    for k, (a, b) in enumerate(combinations(range(len(classes)), 2)):
        p = 1 / (1 + np.exp(-4 * margin[:, k]))
        wins[:, a] += margin[:, k] >= 0
        wins[:, b] += margin[:, k] < 0
        soft[:, a] += np.log(p)
        soft[:, b] += np.log1p(-p)
        sums[:, a] += margin[:, k]
        sums[:, b] -= margin[:, k]
    best = (wins + np.tanh(sums) * 0.4).argmax(axis=1)
    share = np.exp(soft - soft.max(axis=1, keepdims=True))
    return best, (share / share.sum(axis=1, keepdims=True))[np.arange(len(x)), best]


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """A learned language for each text, or ``und`` for a text without a letter, and a score from 0 to 1."""
    lettered = np.array([text is not None and _LETTER.search(text) is not None for text in texts], bool)
    names, score = np.full(len(texts), "und", object), np.zeros(len(texts))
    families, machines = model["families"]
    if families and lettered.any():
        rows = np.flatnonzero(lettered)
        x = vectors([texts[i] for i in rows])
        family, sure = widest(families, machines, x)
        for k, name in enumerate(families):
            own = np.flatnonzero(family == k)
            if len(own):
                languages, within = model["languages"][name]
                best, share = decide(languages, within, x[own])
                names[rows[own]] = np.array(languages, object)[best]
                score[rows[own]] = sure[own] * share
    return list(names), np.clip(score, 0, 1)


def training_sample(docs: DataFrame, bound: int = MAX_PER_LANGUAGE) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and languages of about ``bound`` texts of each language outside the held-out fold, chosen by a hash of the id.

    With many languages there are fewer of each, ``MAX_TAUGHT`` in all. Of several texts of an id and language, that of
    least hash teaches, however often rows are repeated. More than ``MAX_LANGUAGES`` languages are an error.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return np.zeros((0, TERMS + 1), np.float32), np.array([], object)
    bound = min(bound, max(50, MAX_TAUGHT // len(counts)))
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, bound / n) * 1_000_000)).otherwise(share)
    taught = own.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < share).select("doc_id", "lang", "text")
    taught = taught.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _BLOCK):
                batch = whole.slice(at, _BLOCK)
                found = vectors(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([v.astype(np.float16).tobytes() for v in found], pa.binary())], ["doc_id", "lang", "vector"])

    got = sorted((r.lang, r.doc_id, bytes(r.vector)) for r in mapped(taught, run, "doc_id long, lang string, vector binary").collect())
    x = np.array([np.frombuffer(v, np.float16) for _, _, v in got], np.float32).reshape(len(got), TERMS + 1)
    return x, np.array([lang for lang, _, _ in got], object)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    A null text and one without a letter are ``und`` with score 0, as is every text if no language was learned. A null
    language teaches nothing; a null id is in no fold (held_out false) and teaches nothing. Repeated rows are predicted alike.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    x, langs = training_sample(plain)
    model = plain.sparkSession.sparkContext.broadcast(fit(x, langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _BLOCK):
                batch = whole.slice(at, _BLOCK)
                names, score = predict(model.value, batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return mapped(plain.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double").select("doc_id", held.alias("held_out"), "lang_pred", "score")
