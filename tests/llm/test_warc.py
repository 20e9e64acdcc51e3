import gzip
import hashlib

import pytest

from strandline.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def pages():
    big = "<p>ä" + "x" * 300
    rows = [(5, "http://a/1", big), (2, "http://b/2\r\nX: y", big), (9, None, big), (1, "http://a/3", "short"), (3, "http://a/4", "short"), (4, "http://a/5", None), (6, "http://a/6", ""), (7, "http://a/7", "\r\n\r\n" * 40), (8, "u", "long " * 300000)]
    return [(*r, "clash") for r in rows] + [(None, "http://n", big, "clash"), (2, "http://b/2", big, "clash")]


def test_round_trip(spark, tmp_path):
    rows = pages()
    got = warc.archive_report(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "w")).collect()
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        same = [j for j, _, x, _ in rows if (x or "") == (h or "") and j is not None]
        again = len(b) >= 100 and same and i != min(same)
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))
    # any gzip reader sees ordinary records
    raw = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "w").glob("*.warc.gz")))
    assert raw.count(b"WARC/1.1\r\n") == len(rows)


def test_pushdown_and_headers_only(spark, tmp_path):
    df = spark.createDataFrame(pages(), SCHEMA)
    path = warc.archive_pages(df, str(tmp_path / "w"))
    r = warc.read_archives(spark, path)
    some = r.where("record_type = 'revisit' and target_uri like 'http://%'")
    assert sorted(x.record_id for x in some.collect()) == sorted(x.record_id for x in r.collect() if x.record_type == "revisit" and (x.target_uri or "").startswith("http://"))
    heads = warc.read_archives(spark, path, payload=False)
    assert heads.where("payload is not null").count() == 0 and heads.count() == len(pages())
    assert {x.payload_length for x in heads.where("record_id = 'urn:page:8'").collect()} == {1500000}
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 3)]))
    assert len(left) == 1 and reader.wanted({"record_type": "revisit"}) and not reader.wanted({"record_type": "response"})


@pytest.mark.parametrize("packed", [True, False])
def test_files_of_other_writers(spark, tmp_path, packed):
    """Members without a length field, and other record types."""
    rec = lambda kind, i, body: (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{i}>\r\nContent-Type: text/plain\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"
    data = [rec("warcinfo", 0, b"a: b\r\n\r\n"), rec("resource", 1, b"z" * 100000), rec("resource", 2, b""), rec("metadata", 3, b"q")]
    if not packed:
        data = [warc.HEAD[:0] + gzip.compress(x, 1) for x in data]
    else:
        data = [gzip.compress(x) for x in data]
    (tmp_path / "o.warc.gz").write_bytes(b"".join(data))
    got = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert bytes(got["urn:x:1"].payload) == b"z" * 100000 and got["urn:x:0"].payload_length == 8 and len(got) == 4
    one = warc.read_archives(spark, str(tmp_path)).where("record_type = 'metadata'").collect()
    assert [bytes(r.payload) for r in one] == [b"q"]


@pytest.mark.parametrize("size", [50, 700, 5000, 1 << 20])
def test_byte_ranges(spark, tmp_path, size):
    """Cut anywhere, every record is read once; heads within payloads do not mislead."""
    rows = [(i, f"http://a/{i}", ("<p>" + str(i) * 40 + warc.HEAD.decode("latin-1") * (i % 3)), "") for i in range(60)]
    path = warc.archive_pages(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "w"))
    reader = warc.WarcReader({"path": path, "partition_bytes": size})
    parts = reader.partitions()
    total = sum(x.stat().st_size for x in (tmp_path / "w").glob("*.gz"))
    assert len(parts) == max(1, -(-total // size))
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(int(r["record_id"].rpartition(":")[2]) for r in got) == list(range(60))
    assert {r["payload"] for r in got} == {h.encode() for _, _, h, _ in rows}


def test_a_head_within_data(tmp_path):
    """What looks like a head but leads nowhere is passed over, also across the pieces that are searched."""
    rec = warc.encode_record({"record_id": "x", "record_type": "resource", "date": None, "target_uri": None, "payload_digest": None, "payload": b"q" * 50, "payload_length": None, "refers_to": None})
    data = rec + b"junk" * 3 + warc.HEAD + b"\1\0\0\0\0\0\0\0" + rec + rec
    (tmp_path / "f").write_bytes(data)
    fs, path = warc.opened(str(tmp_path / "f"))
    assert warc._first_member(warc._File(fs, path), 1) == len(data) - 2 * len(rec)
    assert warc._first_member(warc._File(fs, path), len(data) - len(rec) + 1) == len(data)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert warc.archive_report(df, str(tmp_path / "w")).collect() == []
