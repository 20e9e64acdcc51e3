"""FASTQ as a Python data source: files are cut into byte ranges, and a task finds its first record by itself.

A record begins at a line with @ that is followed by bases, a line with + and as many qualities as bases;
a quality line that begins with @ does not pass that test. A record belongs to the range its first byte is
in. Compressed files are one range each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = pa.schema([("name", pa.string()), ("flags", pa.string()), ("seq", pa.string()), ("qual", pa.string())])
RANGE_BYTES, ROWS = 64 << 20, 2000
PACKED = (".gz", ".bz2", ".zst")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    lo: int
    hi: int | None

    def __init__(self, path: str, lo: int, hi: int | None) -> None:
        self.path, self.lo, self.hi = path, lo, hi


def _lines(f, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) from ``at`` on; from the first whole line if at > 0."""
    rest = b""
    if at:
        f.seek(at - 1)
        at -= 1
    skip = at > 0 or False
    while chunk := f.read(1 << 20):
        parts = (rest + chunk).split(b"\n")
        rest = parts.pop()
        for p in parts:
            if not skip:
                yield at, p.rstrip(b"\r")
            skip = False
            at += len(p) + 1
    if rest and not skip:
        yield at, rest.rstrip(b"\r")


def records(f, lo: int, hi: int | None) -> Iterator[tuple[bytes, bytes, bytes]]:
    """(header, bases, qualities) of the records that begin in [lo, hi)."""
    held: list[tuple[int, bytes]] = []
    for x in _lines(f, lo):
        held.append(x)
        if len(held) < 4:
            continue
        (at, head), (_, seq), (_, plus), (_, qual) = held
        if head.startswith(b"@") and plus.startswith(b"+") and len(seq) == len(qual) and not seq.startswith((b"@", b"+")):
            if hi is not None and at >= hi:
                return
            yield head[1:], seq, qual
            held = []
        else:
            held.pop(0)


class FastqReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.range_bytes = options["path"], int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        fs, path = opened(self.path)
        info = fs.get_file_info(path)
        files = [info] if info.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if x.type == pafs.FileType.File and not x.base_name.startswith((".", "_"))]
        out = []
        for x in files:
            if x.path.endswith(PACKED):
                out.append(Range(x.path, 0, None))
            else:
                out += [Range(x.path, lo, min(x.size, lo + self.range_bytes)) for lo in range(0, x.size, self.range_bytes)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = opened(self.path)
        f = fs.open_input_stream(partition.path, compression="detect") if partition.hi is None else fs.open_input_file(partition.path)
        rows = []
        for head, seq, qual in records(f, partition.lo, partition.hi):
            name, _, flags = head.decode().partition(" ")
            rows.append({"name": name, "flags": flags.strip(), "seq": seq.decode(), "qual": qual.decode()})
            if len(rows) >= ROWS:
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)


class FastqDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "name string, flags string, seq string, qual string"

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(dict(self.options))


def read_fastq(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(name, flags, seq, qual) of a file or folder, plain or compressed."""
    spark.dataSource.register(FastqDataSource)
    return spark.read.format("fastq").option("range_bytes", range_bytes).load(path)
