"""Sources and sinks: SAM, BAM, annotation files, the command line, a stream."""

import struct
import zlib

import pytest

from peakweave.config import Config
from peakweave.plans import cli
from peakweave.sources import annotation, bam, sam
from peakweave.sources.shipping import ship
from peakweave.streaming import reads as stream

CONTIGS = (("chr1", 100_000), ("chr2", 50_000))
ROWS = [(0, 1000 + k // 2, 16 * (k % 3 == 0), 30, None if k % 2 else 1 + k % 5, "20M500N20M" if k % 7 == 0 else "50M") for k in range(400)] + [(1, 70_0 + k, 0, 9, 1, "10S30M") for k in range(50)]


def _record(contig, pos, flag, mapq, nh, cigar):
    import re

    ops = [(int(n) << 4) | bam.OPERATIONS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    tags = b"XZZabc\0XBBs" + struct.pack("<ihh", 2, 1, 2) + (b"NHC" + bytes([nh]) if nh is not None else b"XAAq")
    body = struct.pack("<iiBBHHHiiii", contig, pos, 2, mapq, 0, len(ops), flag, 3, -1, -1, 0) + b"r\0" + struct.pack(f"<{len(ops)}I", *ops) + b"\x11\x10" + b"\xff" * 3 + tags
    return struct.pack("<i", len(body)) + body


def _write_bam(path, order="coordinate", per_block=700):
    text = (f"@HD\tVN:1.6\tSO:{order}\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in CONTIGS)).encode()
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(CONTIGS))
    head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in CONTIGS)
    data, begins = bytearray(head), []
    for row in ROWS:
        begins.append(len(data))
        data += _record(*row)
    out, places = bytearray(), []
    for at in range(0, len(data), per_block):  # records may lie across blocks
        places.append(len(out))
        squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
        part = bytes(data[at : at + per_block])
        body = squeeze.compress(part) + squeeze.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    places.append(len(out))
    out += bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
    path.write_bytes(out)
    virtual = lambda at: places[at // per_block] << 16 | at % per_block
    index = b"BAI\1" + struct.pack("<i", len(CONTIGS))
    for c in range(len(CONTIGS)):
        own = [k for k, r in enumerate(ROWS) if r[0] == c]
        end = begins[own[-1] + 1] if own[-1] + 1 < len(begins) else len(data)
        # a linear index finer than usual, so that a small file has many ranges
        linear = [virtual(begins[k]) for k in own[::60]]
        last = virtual(end) if end < len(data) else (len(out) - 28) << 16
        index += struct.pack("<iIiQQ", 1, 4681, 1, virtual(begins[own[0]]), last) + struct.pack(f"<i{len(linear)}Q", len(linear), *linear)
    (path.parent / (path.name + ".bai")).write_bytes(index)


def _want(rows=ROWS):
    return sorted((c, CONTIGS[c][0], p, f, q, nh if nh is not None else -1, cig) for c, p, f, q, nh, cig in rows)


def _got(df):
    return sorted((r.contig_index, r.contig, r.pos, r.flag, r.mapq, r.nh if r.nh is not None else -1, r.cigar) for r in df.collect())


def test_bam_in_one_range_or_many(spark, tmp_path):
    ship(spark)
    spark.dataSource.register(bam.BamSource)
    path = tmp_path / "a.bam"
    _write_bam(path)
    whole = spark.read.format("bam").option("order", "coordinate").load(str(path))
    assert whole.rdd.getNumPartitions() == 2 and _got(whole) == _want()
    cut = spark.read.format("bam").option("split_bytes", "300").load(str(path))
    assert cut.rdd.getNumPartitions() > 4 and _got(cut) == _want()
    one = spark.read.format("bam").option("contig", "chr2").load(str(path))
    assert _got(one) == _want([r for r in ROWS if r[0] == 1])
    assert [tuple(r) for r in bam.contigs(spark, str(path)).collect()] == [(k, *c) for k, c in enumerate(CONTIGS)]
    _write_bam(tmp_path / "b.bam")
    for several in (str(tmp_path), f"{tmp_path}/*.bam"):
        assert bam.files_of(several) == [f"{tmp_path}/a.bam", f"{tmp_path}/b.bam"]
        assert _got(spark.read.format("bam").load(several)) == sorted(2 * _want())
    assert bam.files_of(f"{tmp_path}/b*") == [f"{tmp_path}/b.bam"] and bam.contigs(spark, str(tmp_path)).count() == 2
    for none in (f"{tmp_path}/c*", f"{tmp_path}/a.sam"):
        with pytest.raises(ValueError, match="bam"):
            bam.files_of(none)
    _write_bam(path, order="unsorted")
    with pytest.raises(Exception, match="SO:unsorted"):
        spark.read.format("bam").option("order", "coordinate").load(str(path)).collect()


def _write_sam(path):
    lines = ["@HD\tVN:1.6\tSO:coordinate", *(f"@SQ\tSN:{n}\tLN:{k}" for n, k in CONTIGS)]
    lines += ["\t".join(("r", str(f), CONTIGS[c][0], str(p + 1), str(q), cig, "*", "0", "0", "ACG", "III", *([f"NH:i:{nh}"] if nh is not None else []))) for c, p, f, q, nh, cig in ROWS]
    path.write_text("\n".join([*lines, "u\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI", "short\tline"]) + "\n")


def test_sam(spark, tmp_path):
    _write_sam(tmp_path / "a.sam")
    found, contigs = sam.read_sam(spark, str(tmp_path / "a.sam"), check_order=True)
    assert [tuple(r) for r in contigs.collect()] == [(0, "chr1", 100_000), (1, "chr2", 50_000)]
    assert _got(found.where("contig IS NOT NULL")) == _want() and found.where("contig IS NULL").count() == 1
    with pytest.raises(ValueError, match="coordinate"):
        sam.require_sorted(["@HD\tVN:1.6\tSO:queryname"])


def test_annotation_file_keeps_its_order(spark, tmp_path):
    path = tmp_path / "g.gff"
    path.write_text("".join(f"chr1\tx\texon\t{k}\t{k + 5}\t.\t+\t.\tID=e{k};gene_id=g{k // 3}\n" for k in range(1, 50)))
    got = annotation.read_annotation(spark, str(path), Config()).orderBy("line_no").collect()
    assert [r.start for r in got] == list(range(0, 49)) and got[5].gene_id == "g2"


def test_command_line_end_to_end(spark, tmp_path):
    _write_sam(tmp_path / "a.sam")
    (tmp_path / "g.gtf").write_text('chr1\tx\texon\t900\t1400\t.\t+\t.\tgene_id "g1";\nchr1\tx\texon\t900\t1400\t.\t-\t.\tgene_id "g2";\n')
    args = cli.parser().parse_args([str(tmp_path / "a.sam"), "-a", str(tmp_path / "g.gtf"), "--mapq-min=5", "-o", str(tmp_path / "out"), "-n"])
    summary = {r.metric: r.value for r in cli.run(spark, args.reads, cli.config_of(args)).collect()}
    assert summary["total"] == "450" and float(summary["assigned"]) > 100
    assert spark.read.text(f"{tmp_path}/out.counts").count() == 2 and spark.read.text(f"{tmp_path}/out").count() > 7
    assert (tmp_path / "out").is_file() and (tmp_path / "out.counts").read_text().count("\n") == 2 and not list(tmp_path.glob("*.parts-*"))
    cli.run(spark, args.reads, cli.config_of(args))  # an earlier output is replaced
    assert (tmp_path / "out").read_text().startswith("##")
    assert cli.config_of(cli.parser().parse_args(["x.bam"])).output_gtf == "x.bam.gtf"
    assert cli.main([str(tmp_path / "a.sam"), "-a", "genes.txt"]) == 1


def test_stream_totals_equal_the_batch(spark, tmp_path):
    _write_sam(tmp_path / "a.sam")
    found, _ = sam.read_sam(spark, str(tmp_path / "a.sam"))
    for k, part in enumerate(found.randomSplit([0.5, 0.5], 1)):
        part.write.mode("append").parquet(f"{tmp_path}/in")
    query = stream.reject_totals(stream.open_stream(spark, f"{tmp_path}/in").where("contig IS NOT NULL"), Config()).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    query.processAllAvailable()
    query.stop()
    assert {r.contig: r.total for r in spark.table("totals").collect()} == {"chr1": 400, "chr2": 50}
