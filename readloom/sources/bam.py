"""BAM: the binary form of alignments, read as a stream of packed blocks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from readloom.session import ship
from readloom.sources.fastq import list_files, open_file
from readloom.sources.sam import typed_tags

# Fixed values of the format: operations of a CIGAR, letters of packed sequences, and the sizes of the types of tags.
CIGAR, LETTERS = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}

_pairs = [a + b for a in LETTERS for b in LETTERS]
_phred = bytes(min(q + 33, 126) for q in range(256))
SCHEMA = "qname string, flag int, contig string, pos int, mapq int, cigar string, mate_contig string, mate_pos int, isize int, seq string, qual string, t map<string,string>"
_kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
_names = [c.split()[0] for c in SCHEMA.replace("map<string,string>", "map").split(", ")]


def _number(kind: str, v) -> str:
    return repr(v) if kind != "f" else f"{v:.9g}"


def _tags(data: bytes, at: int) -> list[tuple[str, str]]:
    out: dict[str, str] = {}
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode("latin-1"), chr(data[at + 2])
        at += 3
        if kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in NUMBERS:
            f = "<" + NUMBERS[kind]
            value, at = _number(kind, struct.unpack_from(f, data, at)[0]), at + struct.calcsize(f)
        elif kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode("utf-8", "replace"), end + 1
        elif kind == "B":
            of, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            f = f"<{n}{NUMBERS[of]}"
            value, at = ",".join([of, *[_number(of, v) for v in struct.unpack_from(f, data, at + 5)]]), at + 5 + struct.calcsize(f)
        else:
            raise ValueError(f"tag {name} has no type {kind!r}")
        out[name] = value
    return list(out.items())


def _header(f, path: str) -> tuple[str, list[str]]:
    if f.read(4) != b"BAM\1":
        raise ValueError(f"{path} is no BAM file")
    text = f.read(struct.unpack("<i", f.read(4))[0]).split(b"\0")[0].decode("utf-8", "replace")
    contigs = []
    for _ in range(struct.unpack("<i", f.read(4))[0]):
        contigs.append(f.read(struct.unpack("<i", f.read(4))[0])[:-1].decode())
        f.read(4)
    return text, contigs


def _record(d: bytes, contigs: list[str]) -> tuple:
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq, mate, mate_pos, size = struct.unpack_from("<iiBBHHHiiii", d)
    at = 32 + l_name
    ops = struct.unpack_from(f"<{n_ops}I", d, at)
    at += 4 * n_ops
    packed, at = d[at : at + (l_seq + 1) // 2], at + (l_seq + 1) // 2
    qual = d[at : at + l_seq]
    name = lambda i: contigs[i] if i >= 0 else None
    return (
        d[32 : 31 + l_name].decode("latin-1"), flag, name(ref), pos, mapq, "".join(f"{o >> 4}{CIGAR[o & 15]}" for o in ops) or None, name(mate), mate_pos, size,
        "".join([_pairs[b] for b in packed])[:l_seq] or None, None if not qual or qual[0] == 255 else qual.translate(_phred).decode(), _tags(d, at + l_seq),
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip
    import io

    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _kinds)], _names)
    for b in batches:
        for path in b.column(0).to_pylist():
            f = io.BufferedReader(gzip.GzipFile(fileobj=open_file(path)), 1 << 20)
            contigs, rows = _header(f, path)[1], []
            while head := f.read(4):
                rows.append(_record(f.read(struct.unpack("<i", head)[0]), contigs))
                if len(rows) == 10_000:
                    yield pack(rows)
                    rows = []
            if rows:
                yield pack(rows)


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of BAM files, with the columns of ``sam.read_sam``.

    A file is one task, read as a stream: records cross the borders of its packed blocks, so it can't be entered in the middle
    without an index. Many files are read side by side; a large one is best stored once by ``reports.write_alignments``.
    A file that isn't BAM, or is cut off, is an error.
    """
    ship(spark)
    files = list_files(spark, path)
    tasks = spark.createDataFrame([(f,) for f, _ in files], "file string").repartition(max(1, min(len(files), 10_000)), "file")
    return typed_tags(tasks.mapInArrow(_read, SCHEMA))


def bam_header(path: str) -> list[str]:
    """Header lines of one BAM file."""
    import gzip

    return _header(gzip.GzipFile(fileobj=open_file(path)), path)[0].splitlines()
