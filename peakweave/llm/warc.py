"""WARC archives and their index, merged externally.

Write tasks cut their rows into gzipped WARC files. Each file has an index run
beside it, sorted by URL key, timestamp and id. Runs are merged k at a time by a
loser tree, in as many passes as their number needs; the last pass cuts the key
space into ranges, each merged by its own task, and gives the captures in one
global order. Merging streams: a task holds one batch of each of its runs.

A record whose payload another record already has is a revisit: it has headers
only, and names the record that it refers to.

Archives and runs lie in the shared folder, reached through the file systems
that Arrow knows (file, hdfs, s3, gs, abfs). File names are unique to an
attempt, so a task that runs again leaves at most files that no index names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakweave.llm._shared import fits, mapped, materialise, shared_path

MIN_SHARED, ROLL_BYTES, FAN_IN, RANGE_ROWS, BATCH_ROWS, BROADCAST_ROWS = 100, 512 << 20, 64, 1_000_000, 4096, 200_000
#: Where captures have no time, one is made up of the id: so many seconds from here on.
EPOCH, SPAN = 1_700_000_000, 100_000_000
#: Marks of a run, however short, from which ranges are cut; a long one has eight for each range's worth of rows. A range of fewer rows than LEAST_RANGE is not worth a task.
MARKS, LEAST_RANGE = 2, 4096
#: A task reads about so many bytes of archives.
READ_BYTES = 256 << 20

INDEX = pa.schema([("key", pa.string()), ("timestamp", pa.int64()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def url_key(url: str | None) -> str:
    """The host's labels from right to left, then the rest, lower-cased and without scheme, user, ``www.`` and fragment: captures of a site sort together."""
    rest = (url or "").partition("://")[2].partition("#")[0].lower()
    end = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host, _, port = rest[:end].rpartition("@")[2].partition(":")
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + (f":{port}" if port else "") + ")" + (rest[end:] or "/")


def record_id(page_id: int | None) -> str:
    return f"<urn:peakweave:page:{'none' if page_id is None else page_id}>"


def _page_of(text: str) -> int | None:
    own = text.strip("<>").rpartition(":")[2]
    return None if own == "none" else int(own)


def record(page_id: int | None, url: str | None, timestamp: int, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, not compressed. A revisit keeps the response's HTTP headers, with the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    when = f"{_iso(timestamp)}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {when}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _iso(timestamp: int) -> str:
    """The nearest date that has four digits of a year."""
    from datetime import UTC, datetime

    return datetime.fromtimestamp(min(max(timestamp, 0), 253_402_300_799), UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, digest, type, refers to) of a record; a response's payload is measured and hashed again."""
    warc, rest = _headers(data)
    block = rest[: int(warc["content-length"])]
    if len(block) != int(warc["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    page, said = _page_of(warc["warc-record-id"]), warc["warc-payload-digest"].removeprefix("sha256:")
    http, payload = _headers(block)
    if warc["warc-type"] == "revisit":
        return page, int(http["content-length"]), said, "revisit", _page_of(warc["warc-refers-to"])
    digest = hashlib.sha256(payload).hexdigest()
    if digest != said or len(payload) != int(http["content-length"]):
        raise ValueError(f"the payload of record {page} is damaged")
    return page, len(payload), digest, "response", None


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, and only the winner's path is played again."""

    def __init__(self, runs: Iterable[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.head: list[tuple | None] = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or x < y or (x == y and a < b))

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            if self.tree[node] < 0:  # its other side has not played yet
                self.tree[node] = winner
                return
            if self._before(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (row := self.head[winner := self.tree[0]]) is not None:
            yield row
            self.head[winner] = next(self.runs[winner], None)
            self._play(winner)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _order(row: tuple) -> tuple:
    """key, timestamp and id first, an id that is null before the others."""
    key, timestamp, page, archive, offset, length = row
    return key, timestamp, page is not None, page or 0, archive, offset, length


def _unordered(row: tuple) -> tuple:
    key, timestamp, known, page, archive, offset, length = row
    return key, timestamp, page if known else None, archive, offset, length


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*map(_unordered, rows), strict=True)) if rows else [()] * len(INDEX)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, INDEX, strict=True)], schema=INDEX)


def write_run(path: str, rows: Iterable[tuple]) -> int:
    """Sorted rows to an index run; how many there were."""
    store, name = _opened(path)
    n, kept = 0, []
    with store.open_output_stream(name) as out, ipc.new_file(out, INDEX) as run:
        for row in rows:
            kept.append(row)
            n += 1
            if len(kept) == BATCH_ROWS:
                run.write_batch(_table(kept))
                kept = []
        if kept:
            run.write_batch(_table(kept))
    return n


def read_run(path: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """The rows of a run from ``low`` on and before ``high``; the batch to begin with is found by bisection."""
    store, name = _opened(path)
    with store.open_input_file(name) as f:
        run = ipc.open_file(f)
        rows_of = lambda k: [_order(tuple(r.values())) for r in run.get_batch(k).to_pylist()]
        a, b = 0, run.num_record_batches
        while low is not None and b - a > 1:
            middle = (a + b) // 2
            if rows_of(middle)[0] <= low:
                a = middle
            else:
                b = middle
        for k in range(a, run.num_record_batches):
            rows = rows_of(k)
            for row in rows[bisect_left(rows, low) :] if low is not None else rows:
                if high is not None and row >= high:
                    return
                yield row


def _manifest(path: str, rows: list[tuple], step: int) -> tuple[str, int, list[str]]:
    """A run's path, its length, and rows from evenly spaced places (as text), from which ranges are cut."""
    import json

    marks = min(len(rows), max(MARKS, len(rows) // step))
    return path, len(rows), [json.dumps(rows[(2 * k + 1) * len(rows) // (2 * marks)]) for k in range(marks)]


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, sample_step: int = RANGE_ROWS // 8) -> DataFrame:
    """Writes rows ``page_id, url, payload, digest, refers_to, revisit, timestamp``; gives ``run, n, samples``, a row for each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = store = None
        path, rows, done = "", [], []

        def close() -> None:
            nonlocal out, rows
            if out is not None:
                out.close()
                rows.sort()
                write_run(f"{path}.index", rows)
                done.append(_manifest(f"{path}.index", rows, sample_step))
            out, rows = None, []

        for batch in batches:
            for r in zip(*(batch.column(k) for k in range(7)), strict=True):
                page, url, payload, digest, refers, revisit, timestamp = (x.as_py() for x in r)
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    store, name = _opened(path)
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(name, compression=None)
                squeeze = zlib.compressobj(5, zlib.DEFLATED, 31)
                member = squeeze.compress(record(page, url, timestamp, payload, digest, refers, revisit)) + squeeze.flush()
                rows.append(_order((url_key(url), timestamp, page, path, out.tell(), len(member))))
                out.write(member)
                if out.tell() >= roll_bytes:
                    close()
        close()
        columns = list(zip(*done, strict=True)) if done else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.string()))], ["run", "n", "samples"])

    return mapped(pages, run, "run string, n long, samples array<string>")


def merged_index(spark: SparkSession, runs: list[tuple[str, int, list[str]]], folder: str, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of all runs: ``range_id, position`` (their global order) and the columns of the index.

    runs: path, length and samples of each, one for each archive. Ranges have about ``range_rows`` captures, fewer where
    there would be no task for every core. A key with many captures may span ranges.
    """
    import json

    while len(runs) > fan_in:
        groups = [([r[0] for r in runs[k : k + fan_in]], f"{folder}/{uuid.uuid4().hex}") for k in range(0, len(runs), fan_in)]

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for group in batch.to_pylist():
                    path = f"{group['out']}-{uuid.uuid4().hex[:8]}.index"  # an attempt of its own
                    store, name = _opened(path)
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    n = write_run(path, LoserTree([read_run(p) for p in group["paths"]]))
                    yield pa.RecordBatch.from_arrays([pa.array([group["out"]]), pa.array([path]), pa.array([n], pa.int64())], ["out", "run", "n"])

        tasks = spark.createDataFrame(groups, "paths array<string>, out string").repartition(len(groups))
        made = {r.out: (r.run, r.n) for r in mapped(tasks, fold, "out string, run string, n long").collect()}
        samples = [sum((r[2] for r in runs[k : k + fan_in]), []) for k in range(0, len(runs), fan_in)]
        runs = [(*made[out], s) for (_, out), s in zip(groups, samples, strict=True)]
    total = sum(n for _, n, _ in runs)
    marks = sorted((tuple(json.loads(s)), n / len(found)) for _, n, found in runs for s in found)  # each stands for its share of the run
    wanted = max(1, -(-total // range_rows), min(spark.sparkContext.defaultParallelism, total // LEAST_RANGE))
    cuts, held = [], 0.0
    for (mark, _), (_, before) in zip(marks[1:], marks, strict=False):
        held += before
        if held >= (len(cuts) + 1) * total / wanted and len(cuts) + 1 < wanted:
            cuts.append(json.dumps(mark))
    wanted = len(cuts) + 1
    paths = spark.sparkContext.broadcast([p for p, _, _ in runs])  # no more than the fan-in

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                low, high = (part[c] and tuple(json.loads(part[c])) for c in ("low", "high"))
                at, kept = 0, []

                def flush(rows: list[tuple], at: int, part: dict = part) -> pa.RecordBatch:
                    own = [pa.array([part["range_id"]] * len(rows), pa.int32()), pa.array(range(at, at + len(rows)), pa.int64())]
                    return pa.RecordBatch.from_arrays([*own, *_table(rows).columns], ["range_id", "position", *INDEX.names])

                for row in LoserTree([read_run(p, low, high) for p in paths.value]):
                    kept.append(row)
                    if len(kept) == BATCH_ROWS:
                        yield flush(kept, at)
                        at, kept = at + len(kept), []
                if kept:
                    yield flush(kept, at)

    parts = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip([None, *cuts], [*cuts, None], strict=True))], "range_id int, low string, high string")
    return mapped(parts.repartitionByRange(wanted, "range_id"), merge, "range_id int, position long, key string, timestamp long, page_id long, archive string, offset long, length long")


def read_archives(index: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record that the index names; each archive is read once, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            found = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != name:
                    if f is not None:
                        f.close()
                    store, path = _opened(archive)
                    name, f = archive, store.open_input_file(path)
                f.seek(offset)
                found.append(parse(zlib.decompress(f.read(length), 31)))
            columns = list(zip(*found, strict=True)) if found else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # a number of its own, as rows of the index are small and what they name is not: adaptive execution would read all in a task
    size = index.agg(F.sum("length")).first()[0] or 0
    parts = max(index.sparkSession.sparkContext.defaultParallelism, size // READ_BYTES)
    places = index.select("archive", "offset", "length").repartition(parts, "archive").sortWithinPartitions("archive", "offset")
    return mapped(places, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, min_shared: int = MIN_SHARED, folder: str | None = None, **how
) -> tuple[DataFrame, str]:
    """Archives ``pages`` and gives their merged index and the folder that holds them.

    Of records with equal payloads of ``min_shared`` bytes or more, that of the smallest id is the response (each of its
    repeated rows too) and the others are revisits; a record without an id is a revisit if any with one has its payload.
    A null payload is empty, a null URL has the empty key. An empty table gives no archive and an empty index. Captures are
    timed by ``time_col`` (seconds since 1970, or a timestamp; null is 0); without one, as ``pages`` has none, the time is
    made up of the id, and a null id counts as 0. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    page = F.col(id_col).cast("long")
    when = F.coalesce(F.col(time_col).cast("long"), F.lit(0)) if time_col else F.lit(EPOCH) + F.pmod(F.coalesce(page, F.lit(0)), F.lit(SPAN))
    own = pages.select(page.alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), when.cast("long").alias("timestamp"))
    own = own.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("bytes"))
    first = own.where(F.col("bytes") >= min_shared).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    first = materialise(first, "payloads")
    first = F.broadcast(first) if fits(first, BROADCAST_ROWS) else first
    rows = own.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", F.encode("payload", "UTF-8").alias("payload"), "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"), "timestamp")
    runs = [tuple(r) for r in write_archives(rows, folder).collect()]  # a row for each archive, however many its records
    return materialise(merged_index(spark, [(p, n, list(s)) for p, n, s in runs], folder, **how), "captures"), folder
