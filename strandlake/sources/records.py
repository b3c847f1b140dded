"""FASTA and FASTQ as a Python data source: splits that begin and end at records, read as Arrow batches.

A file is cut every ``splitbytes`` bytes. A record belongs to the split in which its first byte lies, so a reader first looks for the next
record start and ends with the record that its split's last byte is in. Rows carry the file's number, the split and their
place in the split; ``with_ordinals`` turns these into numbers in file order by counting the splits' rows, without moving any row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_READ = 1 << 20
#: Bytes of records in a batch.
_BATCH = 4 << 20
SPLIT_BYTES = 64 << 20


@dataclass
class Split(InputPartition):
    path: str
    file: int
    number: int
    begin: int
    end: int


def _open(path: str):
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files in order of their names; hidden ones and markers are left out."""
    fs, at = _open(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else sorted((f for f in fs.get_file_info(pafs.FileSelector(at)) if f.is_file), key=lambda f: f.path)
    return [(prefix + f.path, f.size) for f in found if not f.base_name.startswith((".", "_"))]


class Lines:
    """Lines of a file from a byte on, with where each begins."""

    def __init__(self, path: str, begin: int):
        fs, at = _open(path)
        self.file = fs.open_input_file(at)
        self.file.seek(begin)
        self.begin, self.left, self.over = begin, b"", False

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        with self.file:
            while True:
                data = self.file.read(_READ)
                lines = (self.left + data).split(b"\n")
                self.left = lines.pop()
                for line in lines:
                    at, self.begin = self.begin, self.begin + len(line) + 1
                    yield at, line.rstrip(b"\r")
                if not data:
                    if self.left:
                        yield self.begin, self.left.rstrip(b"\r")
                    return


def fasta_records(path: str, begin: int, end: int) -> Iterator[tuple[str, str]]:
    """(header, bases) of the records that begin in [begin, end): blank lines and N are dropped, bases upper-cased."""
    head, body = None, []
    lines = iter(Lines(path, max(0, begin - 1)))
    if begin:
        next(lines, None)  # the line that holds the byte before the split: a split at a line's start loses only the line break
    for at, line in lines:
        if line.startswith(b">"):
            if head is not None:
                yield head, b"".join(body).translate(_UPPER, b"Nn \t").decode()
                head = None
            if at >= end:
                return
            head, body = line[1:].decode(), []
        elif head is not None:
            body.append(line)
    if head is not None:
        yield head, b"".join(body).translate(_UPPER, b"Nn \t").decode()


_UPPER = bytes(range(256)).upper()


def fastq_records(path: str, begin: int, end: int) -> Iterator[tuple[str, str, str]]:
    """(name, bases, qualities) of the four-line records that begin in [begin, end).

    A record begins at a line with ``@`` whose second next line has ``+``: two lines after a quality line is a sequence.
    """
    lines = iter(Lines(path, max(0, begin - 1)))
    if begin:
        next(lines, None)
    held: list[tuple[int, bytes]] = []
    aligned = begin == 0
    for at, line in lines:
        if not aligned:
            held.append((at, line))
            if len(held) < 3:
                continue
            if not (held[0][1].startswith(b"@") and held[2][1].startswith(b"+")):
                held.pop(0)
                continue
            aligned = True
            if held[0][0] >= end:
                return
            continue
        if not held:
            if not line:
                continue
            if at >= end:
                return
            if not line.startswith(b"@"):
                raise ValueError(f"{path}: no record begins at byte {at}")
        held.append((at, line))
        if len(held) == 4:
            yield held[0][1][1:].decode(), held[1][1].decode(), held[3][1].decode()
            held = []
    if aligned and held and any(x for _, x in held):
        if len(held) == 3:  # an empty quality line at the end of the file
            yield held[0][1][1:].decode(), held[1][1].decode(), ""
        else:
            raise ValueError(f"{path}: the last record is cut off")


def line_records(path: str, begin: int, end: int) -> Iterator[tuple[str]]:
    """The lines that begin in [begin, end)."""
    lines = iter(Lines(path, max(0, begin - 1)))
    if begin:
        next(lines, None)
    for at, line in lines:
        if at >= end:
            return
        yield (line.decode(),)


#: Of each format: columns and reader.
KINDS = {"fasta": (["header", "seq"], fasta_records), "fastq": (["name", "seq", "qual"], fastq_records), "numbered_lines": (["value"], line_records)}


class RecordReader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.path = kind, options["path"]
        self.size = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        out = []
        for number, (path, size) in enumerate(files(self.path)):
            out += [Split(path, number, i, begin, min(begin + self.size, size)) for i, begin in enumerate(range(0, size, self.size))]
        return out or [Split("", 0, 0, 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        names, records_of = KINDS[self.kind]
        records = records_of(partition.path, partition.begin, partition.end)
        held, size, before = [], 0, 0

        def batch() -> pa.RecordBatch:
            n = len(held)
            place = [pa.array([partition.file] * n, pa.int32()), pa.array([partition.number] * n, pa.int32()), pa.array(range(before, before + n), pa.int64())]
            return pa.RecordBatch.from_arrays([*place, *(pa.array(c, pa.string()) for c in zip(*held, strict=True))], names=["file", "split", "row", *names])

        for record in records:
            held.append(record)
            size += sum(map(len, record))
            if size >= _BATCH:
                yield batch()
                before, size = before + len(held), 0
                held = []
        if held:
            yield batch()


class RecordSource(DataSource):
    """``spark.read.format("fasta").option("splitbytes", n).load(path)``, and so for ``fastq`` and ``numbered_lines``."""

    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return "file int, split int, row long, " + ", ".join(f"{c} string" for c in KINDS[self.kind][0])

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.kind, self.options)


SOURCES = {kind: type(f"{kind.title().replace('_', '')}Source", (RecordSource,), {"kind": kind}) for kind in KINDS}


def load(spark: SparkSession, kind: str, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(SOURCES[kind])
    return spark.read.format(kind).option("splitbytes", split_bytes).load(path)


def with_ordinals(records: DataFrame, name: str) -> DataFrame:
    """Adds the record's number in file order: what all splits before its own hold, plus its place. A row a split reaches the driver."""
    counts = sorted((r.file, r.split, r.n) for r in records.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n")).collect())
    before = accumulate((n for _, _, n in counts), initial=0)
    base = records.sparkSession.createDataFrame([(f, s, b) for (f, s, _), b in zip(counts, before, strict=False)], "file int, split int, base long")
    return records.join(F.broadcast(base), ["file", "split"]).withColumn(name, F.col("base") + F.col("row")).drop("base", "file", "split", "row")
