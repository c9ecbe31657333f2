"""Near-duplicate embeddings by cross-polytope hashing.

A vector is turned by fast pseudo-random rotations (three rounds of random
signs and a Hadamard transform); its hash is the signed axis that it lies
nearest to. Several hashes make the bucket of a table, and each vector also
probes the buckets in which one hash is replaced by its second-best axis.
Vectors that meet in a bucket, at least one of them at home there, are verified
by their exact cosine in double precision.

Equal vectors of a label count as one. Links are counted where a pair meets
first, as blocked matrix products, and leave a tile as counts and stars: pairs
are never emitted, so a dense bucket costs time but neither rows nor memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.llm._shared import mapped, materialise
from peakweave.llm.components import connected_components
from peakweave.llm.tiles import map_tiles, runs, stars, tiled

THRESHOLD, TABLES, SEED = 0.98, 8, 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unnormalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x


def codes(x: np.ndarray, tables: int, hashes: int, seed: int = SEED) -> np.ndarray:
    """Bucket codes of unit rows, shaped (rows, tables, 1 + hashes): at home first, then each hash's second-best axis in turn."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    rng = np.random.default_rng([seed, width])
    best, second = np.empty((n, tables, hashes), np.int64), np.empty((n, tables, hashes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        for k in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), width))
            size = np.abs(y)
            for out in (best, second):
                axis = size.argmax(axis=1)
                out[:, t, k] = 2 * axis + (y[rows, axis] < 0)
                size[rows, axis] = -1
    out = np.empty((n, tables, 1 + hashes), np.int64)
    for p in range(1 + hashes):
        code = np.zeros((n, tables), np.int64)
        for k in range(hashes):
            code = code * (2 * width) + (second if p == k + 1 else best)[:, :, k]
        out[:, :, p] = code
    return out


def unit(values: list) -> np.ndarray | None:
    """The vector at length one, in double precision; None if it can link with nothing."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()
    return x / math.sqrt(float(x @ x))


def _hashed(classes: DataFrame, tables: int, hashes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                vectors = [unit(v) for v in batch.column("embedding").to_pylist()]
                for dim in {len(v) for v in vectors if v is not None}:
                    own = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim]
                    x = np.array([vectors[i] for i in own])
                    found, kept = codes(x, tables, hashes), batch.take(pa.array(own))
                    columns = {c: kept.column(c) for c in ("rep", "label")} | {"dim": pa.array([dim] * len(own), pa.int32()), "many": kept.column("many")}
                    columns |= {"vector": pa.array([v.tobytes() for v in x], pa.binary()), "signature": pa.array([c.tobytes() for c in found], pa.binary())}
                    columns |= {"buckets": pa.array(found.reshape(len(own), -1).tolist(), pa.list_(pa.int64()))}
                    yield pa.RecordBatch.from_pydict(columns)

    return mapped(classes, run, "rep long, label string, dim int, many long, vector binary, signature binary, buckets array<long>")


def _first_meeting(sig_a: np.ndarray, sig_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table and bucket in which each pair is counted; a is the smaller id of each pair."""
    table, bucket = np.full(len(sig_a), -1), np.full(len(sig_a), -1)
    for t in range(sig_a.shape[1]):
        a_home = (sig_b[:, t] == sig_a[:, t, :1]).any(axis=1)
        b_home = (sig_a[:, t] == sig_b[:, t, :1]).any(axis=1)
        new = (table < 0) & (a_home | b_home)
        table[new] = t
        bucket[new] = np.where(a_home, sig_a[:, t, 0], sig_b[:, t, 0])[new]
    return table, bucket


def _counted(threshold: float, tables: int):
    def work(rows: pa.Table) -> pa.Table | None:
        rep, many, side, home = (rows[c].to_numpy() for c in ("rep", "many", "side", "home"))
        table, key = rows["t"].to_numpy(), rows["key"].to_numpy()
        starts, sizes = runs(rows["tile"].to_numpy())
        vector, signature = rows["vector"], rows["signature"]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for s, n in zip(starts, sizes, strict=True):
            if n < 2:
                continue
            x = np.frombuffer(b"".join(vector.slice(s, n).to_pylist()), np.float64).reshape(n, -1)
            linked = np.zeros((n, n), bool)
            ids, home_of, sides, count = rep[s : s + n], home[s : s + n], side[s : s + n], np.zeros(n, np.int64)
            weight, sig = many[s : s + n], None
            for at in range(0, n, 128):
                near = x[at : at + 128] @ x.T >= threshold
                near &= home_of[at : at + 128, None] | home_of[None, :]
                near &= ids[at : at + 128, None] < ids[None, :]
                near &= (sides[at : at + 128, None] == 2) | (sides[at : at + 128, None] != sides[None, :])
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                linked[at : at + 128] |= near
                if sig is None:
                    sig = np.frombuffer(b"".join(signature.slice(s, n).to_pylist()), np.int64).reshape(n, tables, -1)
                i += at
                for part in range(0, len(i), 1 << 15):
                    a, b = i[part : part + (1 << 15)], j[part : part + (1 << 15)]
                    t, bucket = _first_meeting(sig[a], sig[b])
                    own = (t == table[s]) & (bucket == key[s])
                    count += np.bincount(a[own], weight[b[own]], n).astype(np.int64) + np.bincount(b[own], weight[a[own]], n).astype(np.int64)
            if sig is None:
                continue
            root, other = stars(linked | linked.T)
            got = np.flatnonzero(count)
            out.append((ids[got], ids[got], count[got], np.ones(len(got), bool)))
            out.append((ids[root], ids[other], np.zeros(len(root), np.int64), np.zeros(len(root), bool)))
        if not out:
            return None
        a, b, links, counts = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"a": a, "b": b, "links": links})

    return work


def hashes_for(rows: int, dim: int) -> int:
    """So many hashes to a bucket that rows of unlike vectors rarely meet: the buckets of a table outnumber the rows 16 to 1."""
    return max(2, math.ceil(math.log(max(2, 16 * rows)) / math.log(2 * max(2, 1 << (dim - 1).bit_length()))))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tables: int = TABLES) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Only vectors of one label (not null) and of one length are compared. A vector that is null, empty, zero or holds a null
    or a non-finite component links with nothing: it has no links and is a component of its own. Repeated rows and equal
    vectors link with one another. An empty table gives no rows; other columns are not read.
    """
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda v: v != 0)
    whole = F.transform("embedding", lambda v: v + F.lit(0.0))  # -0.0 is 0.0
    keys = [F.xxhash64("label", whole).alias("k1"), F.xxhash64(F.lit(1), whole, "label").alias("k2")]
    members = plain.select("vec_id", F.coalesce(valid, F.lit(False)).alias("valid"), *keys)
    classes = materialise(plain.where(valid).select("vec_id", "label", "embedding", *keys).groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"), F.min(F.struct("label", "embedding")).alias("e")).select("k1", "k2", "rep", "many", "e.*"), "classes")
    size = classes.groupBy("label", F.size("embedding").alias("dim")).count().agg(F.max("count").alias("n"), F.max("dim").alias("d")).first()
    hashed = materialise(_hashed(classes.select("rep", "label", "embedding", "many"), tables, hashes_for(size.n or 1, size.d or 2)), "hashed")
    each = F.posexplode("buckets").alias("at", "key")
    spread = hashed.select("rep", "label", "dim", (F.size("buckets") / tables).cast("int").alias("probes"), each)
    where = spread.select("rep", "label", "dim", F.expr("at div probes").cast("int").alias("t"), "key", F.expr("at % probes = 0").alias("home"))
    bucket = ["label", "dim", "t", "key"]
    meeting = materialise(where.groupBy(*bucket, "rep").agg(F.max("home").alias("home")), "meetings")
    rows = tiled(meeting, bucket, "rep", worth=F.max("home")).join(hashed.select("rep", "many", "vector", "signature"), "rep").select("tile", "side", "t", "key", "home", "rep", "many", "vector", "signature")
    found = materialise(map_tiles(rows, _counted(threshold, tables), "a long, b long, links long", ["rep"]), "found")
    linked = connected_components(found.where("a <> b"), "a", "b").withColumnRenamed("node", "rep")
    links = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    about = classes.select("k1", "k2", "rep", "many").join(links, "rep", "left").join(linked, "rep", "left")
    about = about.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    with_class = members.where("valid").join(about, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = members.where("NOT valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return with_class.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
