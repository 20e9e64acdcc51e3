"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Records are gzip members of their own (WARC/1.1 Annex D) whose FEXTRA field "sl" holds the compressed
length, so a reader inflates a record's headers first and seeks past what it does not want. Files from
other writers have no such field; their unwanted payloads are inflated piecewise and dropped.

Columns: record_id, record_type, target_uri, date, payload_digest (bare SHA-256 hex), payload_length,
refers_to, payload. The block is an HTTP response; a revisit has its head alone, whose Content-Length
still tells the full payload's length.

Reader options: path (a file or folder), payload ("false": headers only), partition_bytes (files are cut there at the next record,
if their records tell their lengths; others are read whole). Filters on
record_type, target_uri, record_id, refers_to, payload_digest and date are pushed down and decided on
headers alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from .common import lookup, shared_dir, staged, tune

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_length bigint, refers_to string, payload binary"
ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: gzip member head: magic, deflate, FEXTRA, no time, no flags, unknown system; then XLEN 12: "sl", 8, two lengths.
HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x0c\x00sl\x08\x00"
END = b"\r\n\r\n"
FILE_BYTES, PARTITION_BYTES, PIECE = 1 << 30, 128 << 20, 1 << 16


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """Any store that Arrow knows by URI; a bare path is local."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def encode_record(r: dict, level: int = 3) -> bytes:
    """One gzip member."""
    payload = r["payload"] or b""
    revisit = r["record_type"] == "revisit"
    length = r["payload_length"] if r["payload_length"] is not None else len(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + (b"" if revisit else payload)
    head = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Date", r["date"] or "1970-01-01T00:00:00Z"), ("WARC-Target-URI", r["target_uri"]), ("WARC-Payload-Digest", r["payload_digest"] and f"sha256:{r['payload_digest']}")]
    head += [("WARC-Refers-To", r["refers_to"] and f"<{r['refers_to']}>"), ("WARC-Profile", PROFILE)] if revisit else []
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    raw = ("WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in head if v is not None) + "\r\n").encode() + block + END
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush() + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    total = len(HEAD) + 8 + len(body)
    return HEAD + struct.pack("<II", total & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF) + body


class _File:
    """Random reads of one file through a window of a megabyte."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.f, self.at, self.held = fs.open_input_file(path), 0, b""
        self.size = self.f.size()

    def get(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.f.seek(at)
            self.at, self.held = at, self.f.read(max(n, 1 << 20))
        return self.held[at - self.at : at - self.at + n]


def _first_member(f: _File, at: int) -> int:
    """Where the first member from ``at`` on begins, in a file whose members tell their lengths.

    A head within compressed data is told from a member's by where its length leads: to another head or to the end.
    """
    while at < f.size:
        piece = f.get(at, min(1 << 20, f.size - at))
        k = piece.find(HEAD)
        if k < 0:
            at += max(1, len(piece) - len(HEAD) + 1)
            continue
        head = f.get(at + k, min(len(HEAD) + 8, f.size - at - k))
        end = at + k + struct.unpack("<I", head[16:20])[0] if len(head) >= 20 else 0
        if end == f.size or at + k < end < f.size and f.get(end, min(len(HEAD), f.size - end)) == HEAD:
            return at + k
        at += k + 1
    return f.size


def _members(f: _File, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, int | None]]:
    """Start and, where known, length of each gzip member that begins in [lo, hi); the caller sends back where the member ended."""
    at, last = _first_member(f, lo) if lo else 0, f.size if hi is None else hi
    while at < last:
        head = f.get(at, len(HEAD) + 8)
        known = struct.unpack("<I", head[16:20])[0] if head.startswith(HEAD) else None
        end = yield at, known
        at = at + known if known else end


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def read_file(fs: pafs.FileSystem, path: str, wanted: Callable[[dict], bool], payload: bool, lo: int = 0, hi: int | None = None) -> Iterator[dict]:
    """Records that begin in [lo, hi) and whose headers are wanted. Headers are inflated first; other payloads are never held."""
    f = _File(fs, path)
    members = _members(f, lo, hi)
    step = next(members, None)
    while step is not None:
        at, known = step
        z, pos, raw = zlib.decompressobj(31), at, b""
        limit = at + known if known else f.size

        def more(n: int) -> bytes:
            nonlocal pos
            piece = f.get(pos, min(PIECE, limit - pos)) if not z.unconsumed_tail else b""
            pos += len(piece)
            return z.decompress(z.unconsumed_tail + piece, n)  # noqa: B023

        def ended() -> bool:
            return z.eof or (pos >= limit and not z.unconsumed_tail)  # noqa: B023

        while END not in raw and not ended():
            raw += more(4096)
        head, _, rest = raw.partition(END)
        h = _fields(head)
        r = {"record_id": h.get("warc-record-id", "").strip("<>") or None, "record_type": h.get("warc-type"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "payload_digest": h.get("warc-payload-digest", "").partition("sha256:")[2] or None, "refers_to": h.get("warc-refers-to", "").strip("<>") or None, "payload_length": None, "payload": None}
        take, http = wanted(r), h.get("content-type", "").startswith("application/http")
        length = int(h.get("content-length") or 0)
        if take and http:
            while END not in rest and len(rest) < length and not ended():
                rest += more(4096)
            inner, _, body = rest[:length].partition(END) if END in rest[:length] else (rest[:length], b"", b"")
            full = _fields(inner).get("content-length")
            skip = len(inner) + len(END)
            r["payload_length"] = int(full) if full and full.isdigit() else length - skip
        else:
            body, skip = rest[:length], 0
            r["payload_length"] = length
        if take and payload:
            pieces, have = [rest], len(rest)
            while have < length and not ended():
                pieces.append(more(1 << 20))
                have += len(pieces[-1])
            r["payload"] = b"".join(pieces)[skip:length]
        if take:
            yield r
        if known is None:
            while not z.eof and not ended():
                more(1 << 20)
            step = _sent(members, pos - len(z.unused_data))
        else:
            step = next(members, None)


def _sent(members, end: int):
    try:
        return members.send(end)
    except StopIteration:
        return None


@dataclass
class Files(InputPartition):
    """Archives that one task reads: path, first byte, and the byte behind the last (none: the end)."""

    parts: list[tuple[str, int, int | None]]

    def __init__(self, parts: list[tuple[str, int, int | None]]) -> None:
        self.parts = parts


class WarcReader(DataSourceReader):
    FIELDS = ("record_type", "target_uri", "record_id", "refers_to", "payload_digest", "date")

    def __init__(self, options: dict) -> None:
        self.path, self.payload = options["path"], str(options.get("payload", "true")).lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: "eq", In: "in", IsNotNull: "some", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "holds"}
        for f in filters:
            name = f.attribute[0] if type(f) in kinds and len(f.attribute) == 1 else None
            if name in self.FIELDS:
                self.tests.append((name, kinds[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, r: dict) -> bool:
        tests = {"eq": lambda a, v: a == v, "in": lambda a, v: a in v, "some": lambda a, v: True, "starts": lambda a, v: a.startswith(v), "ends": lambda a, v: a.endswith(v), "holds": lambda a, v: v in a}
        return all(r[n] is not None and tests[k](r[n], v) for n, k, v in self.tests)

    def partitions(self) -> Sequence[InputPartition]:
        fs, path = opened(self.path)
        info = fs.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        files = sorted((-x.size, x.path) for x in found if x.type == pafs.FileType.File and not x.base_name.startswith((".", "_")))
        bins: list[tuple[int, list[tuple[str, int, int | None]]]] = []
        for size, p in files:  # the largest first; a bin is full at partition_bytes
            if -size > self.partition_bytes and _File(fs, p).get(0, len(HEAD)) == HEAD:  # its members tell their lengths: by ranges
                bins += [(self.partition_bytes, [(p, lo, min(lo + self.partition_bytes, -size))]) for lo in range(0, -size, self.partition_bytes)]
            elif bins and bins[-1][0] - size <= self.partition_bytes:
                bins[-1] = (bins[-1][0] - size, [*bins[-1][1], (p, 0, None)])
            else:
                bins.append((-size, [(p, 0, None)]))
        return [Files(x) for _, x in bins] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        rows, held = [], 0
        for p, lo, hi in partition.parts:
            for r in read_file(fs, p, self.wanted, self.payload, lo, hi):
                rows.append(r)
                held += len(r["payload"] or b"")
                if len(rows) >= 1000 or held >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes hidden files; the driver's commit gives them their names, so a lost task leaves nothing."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.level = options["path"], int(options.get("level", 3))
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        names, out, done = [], None, 0
        for b in iterator:
            for r in b.to_pylist():
                if out is None:
                    names.append(f".part-{uuid.uuid4().hex}.warc.gz")
                    out, done = fs.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                data = encode_record(r, self.level)
                out.write(data)
                done += len(data)
                if done >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(path)):
                if x.base_name.endswith(".warc.gz") and not x.base_name.startswith("."):
                    fs.delete_file(x.path)
        for m in messages:
            for n in m.names if m else []:
                fs.move(f"{path}/{n}", f"{path}/{n[1:]}")

    def abort(self, messages) -> None:
        fs, path = opened(self.path)
        for m in messages:
            for n in m.names if m else []:
                fs.delete_file(f"{path}/{n}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    tune(spark)
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame, min_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as records; of equal payloads of ``min_bytes`` or more all but the smallest page_id are revisits.

    Null html is an empty payload, null url has no target. Rows that share the smallest id are all
    responses, as are those of a payload that only rows without id have. Payloads are compared by
    SHA-256, so only digests are shuffled to find copies; html moves once, by page_id, unless Spark
    knows the table of revisits to be below its broadcast threshold.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    small = staged(rows.select("page_id", "digest", F.octet_length("html").alias("bytes")).where(F.col("bytes") >= min_bytes), "digests")
    first = small.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = lookup(small, staged(first, "firsts"), "digest", "n").where("first is not null and not page_id <=> first")
    revisits = staged(revisits.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "first").distinct(), "revisits")
    rows = rows.join(revisits, rows["page_id"].eqNullSafe(F.col("_p")) & (rows["digest"] == F.col("_d")), "left")
    again = F.col("first").isNotNull()
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return rows.select(F.coalesce(urn(F.col("page_id")), F.lit("urn:page:null")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), F.lit(None).cast("string").alias("date"), F.col("digest").alias("payload_digest"), F.octet_length("html").cast("long").alias("payload_length"), F.when(again, urn(F.col("first"))).alias("refers_to"), F.when(~again, F.col("html").cast("binary")).alias("payload"))


def archive_pages(pages: DataFrame, path: str | None = None, **options) -> str:
    """Writes pages as WARC files and returns their folder, by default one in the shared folder."""
    spark = pages.sparkSession
    register(spark)
    path = path or f"{shared_dir(spark)}/warc"
    page_records(pages, **options).write.format("warc").mode("append").save(path)
    return path


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive_report(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archives, reads them back and tells of each page what the archives say; responses' digests and lengths are computed anew."""
    r = read_archives(pages.sparkSession, archive_pages(pages, path))
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    own = F.col("record_type") == "response"
    return r.select(page(F.col("record_id")).alias("page_id"), F.when(own, F.length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"), F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", page(F.col("refers_to")).alias("refers_to"), "target_uri")
