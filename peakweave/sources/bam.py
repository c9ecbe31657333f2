"""BAM as a Spark data source: ``spark.dataSource.register(BamSource); spark.read.format("bam").load(path)``.

The path is a file, a folder, or a pattern in the last part of its name. Each file's index (``path`` + ``.bai``) cuts each contig into ranges of virtual
offsets, so that a file is read by many tasks and a contig filter reads that
contig's ranges only. Give the option ``contig`` to read one, ``order`` =
``coordinate`` to insist on a sorted file, and ``split_bytes`` for the size of
a range. Files are opened with Arrow's file systems.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from peakweave.schemas import CONTIGS, READS
from peakweave.sources.sam import require_sorted

OPERATIONS = "MIDNSHP=X"
SPLIT_BYTES = 32 << 20
#: Reads of an Arrow batch.
BATCH_ROWS = 8192
_ARROW = pa.schema([(n, pa.string() if t == "string" else pa.int32()) for n, t in (c.split() for c in READS.split(", "))])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _opened(path: str):
    store, name = _store(path)
    return store.open_input_file(name)


def files_of(path: str) -> list[str]:
    """The BAM files of a file's name, a folder, or a pattern in the last part of a name, by name."""
    folder, _, last = path.rpartition("/")
    pattern = any(c in last for c in "*?[")
    store, name = _store((folder or ".") if pattern else path)
    if not pattern and store.get_file_info(name).type != fs.FileType.Directory:
        if not path.endswith(".bam"):
            raise ValueError(f"{path}: not a .bam file")
        return [path]
    base = ((folder or ".") if pattern else path).rstrip("/")
    names = [f.base_name for f in store.get_file_info(fs.FileSelector(name)) if f.type == fs.FileType.File]
    found = sorted(n for n in names if n.endswith(".bam") and (not pattern or fnmatchcase(n, last)))
    if not found:
        raise ValueError(f"{path}: no .bam file")
    return [f"{base}/{n}" for n in found]


def contigs(spark: SparkSession, path: str) -> DataFrame:
    """``contig_index, contig, length`` of the references in the header; of several files, which must agree in them."""
    found = None
    for name in files_of(path):
        with _opened(name) as f:
            own = read_header(Blocks(f))[1]
        if found not in (None, own):
            raise ValueError(f"{name}: other contigs than the files before it")
        found = own
    return spark.createDataFrame(found, CONTIGS)


class Blocks:
    """The bytes of a blocked gzip file from a virtual offset on: the place of a block in the file, and a place in what it holds."""

    def __init__(self, f, offset: int = 0):
        self.f, self.at, self.next, self.data, self.pos = f, 0, offset >> 16, b"", 0
        if self._load():
            self.pos = offset & 0xFFFF

    def _load(self) -> bool:
        self.at = self.next
        self.f.seek(self.at)
        head = self.f.read(12)
        if len(head) < 12:
            self.data, self.pos = b"", 0
            return False
        extra = self.f.read(struct.unpack("<H", head[10:12])[0])
        size, k = 0, 0
        while k + 4 <= len(extra):
            n = struct.unpack("<H", extra[k + 2 : k + 4])[0]
            if extra[k : k + 2] == b"BC":
                size = struct.unpack("<H", extra[k + 4 : k + 6])[0] + 1
            k += 4 + n
        if head[:2] != b"\x1f\x8b" or not size:
            raise ValueError("not a blocked gzip file")
        body = self.f.read(size - 12 - len(extra))
        self.data, self.pos, self.next = zlib.decompress(body[:-8], -15), 0, self.at + size
        return True

    def tell(self) -> int:
        while self.pos >= len(self.data):  # the end of a block is the start of the next
            if not self._load():
                break
        return self.at << 16 | self.pos

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.pos >= len(self.data) and not self._load():
                break
            part = self.data[self.pos : self.pos + n - len(out)]
            self.pos += len(part)
            out += part
        return out


def read_header(blocks: Blocks) -> tuple[list[str], list[tuple[int, str, int]]]:
    """(header lines, contigs as (index, name, length))."""
    if blocks.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = blocks.read(struct.unpack("<i", blocks.read(4))[0]).rstrip(b"\0").decode()
    contigs = []
    for k in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        contigs.append((k, name, struct.unpack("<i", blocks.read(4))[0]))
    return text.splitlines(), contigs


def read_index(data: bytes) -> list[tuple[int, int, list[int]]]:
    """For each contig, its first and last virtual offset (0, 0 if it has no reads) and the offsets of its linear index."""
    if data[:4] != b"BAI\1":
        raise ValueError("not a BAM index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        low, high = 0, 0
        bins = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", data, at)
            at += 8
            for k in range(chunks if number != 37450 else 0):  # that one holds statistics, not reads
                a, b = struct.unpack_from("<QQ", data, at + 16 * k)
                low, high = min(low or a, a), max(high, b)
            at += 16 * chunks
        n = struct.unpack_from("<i", data, at)[0]
        linear = list(struct.unpack_from(f"<{n}Q", data, at + 4))
        at += 4 + 8 * n
        out.append((low, high, linear))
    return out


_WIDTH = {b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4, b"A": 1}
_KIND = {b"c": "b", b"C": "B", b"s": "h", b"S": "H", b"i": "i", b"I": "I"}


def hits_of(tags: bytes) -> int | None:
    """The NH tag, or None."""
    at = 0
    while at + 3 <= len(tags):
        name, kind = tags[at : at + 2], tags[at + 2 : at + 3]
        at += 3
        if name == b"NH" and kind in _KIND:
            return struct.unpack_from("<" + _KIND[kind], tags, at)[0]
        if kind in (b"Z", b"H"):
            at = tags.index(b"\0", at) + 1
        elif kind == b"B":
            at += 5 + _WIDTH[tags[at : at + 1]] * struct.unpack_from("<i", tags, at + 1)[0]
        else:
            at += _WIDTH[kind]
    return None


def read_records(blocks: Blocks, stop: int, names: list[str]) -> Iterator[tuple]:
    """Rows of the reads that begin before the virtual offset ``stop``; reads without a place have no contig."""
    while blocks.tell() < stop and len(size := blocks.read(4)) == 4:
        data = blocks.read(struct.unpack("<i", size)[0])
        contig, pos, n_name, mapq, _, n_ops, flag, n_bases = struct.unpack_from("<iiBBHHHi", data)
        ops = struct.unpack_from(f"<{n_ops}I", data, 32 + n_name)
        tags = 32 + n_name + 4 * n_ops + (n_bases + 1) // 2 + n_bases
        cigar = "".join(f"{op >> 4}{OPERATIONS[op & 15]}" for op in ops) or "*"
        placed = contig >= 0
        yield contig if placed else None, names[contig] if placed else None, pos if placed else None, flag, mapq, hits_of(data[tags:]), cigar


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = files_of(options.get("path", ""))
        self.contig, self.order, self.split = options.get("contig"), options.get("order"), int(options.get("split_bytes", SPLIT_BYTES))

    def _ranges(self, path: str) -> Iterator[Range]:
        with _opened(path) as f:
            header, contigs = read_header(Blocks(f))
        if self.order == "coordinate":
            require_sorted(header)
        with _opened(path + ".bai") as f:
            index = read_index(f.read())
        for (_, name, _), (low, high, linear) in zip(contigs, index, strict=True):
            if not high or self.contig not in (None, name):
                continue
            start = low
            for place in sorted(set(linear)):
                if place > start and (place >> 16) - (start >> 16) >= self.split:
                    yield Range(path, start, place)
                    start = place
            yield Range(path, start, high)

    def partitions(self) -> list[Range]:
        return [r for path in self.paths for r in self._ranges(path)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.stop:
            return
        with _opened(partition.path) as f:
            names = [name for _, name, _ in read_header(Blocks(f))[1]]
            for rows in batched(read_records(Blocks(f, partition.start), partition.stop, names), BATCH_ROWS):
                columns = [pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), _ARROW, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> BamReader:
        return BamReader(dict(self.options))
