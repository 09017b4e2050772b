"""Archive reading: spread over tasks, and tolerant of other writers' headers."""

import zlib

import pytest

from keyrhythm.llm import warc
from keyrhythm.llm.warc import parse, read_warc, write_warc
from odd import prose


def packed(head: bytes, body: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def test_ranges_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", prose(i, 900)) for i in range(120)], "page_id long, url string, html string").repartition(1)
    write_warc(pages, f"{tmp_path}/w")
    size = sum(p.stat().st_size for p in (tmp_path / "w").iterdir() if p.name.startswith("part"))
    got = read_warc(spark, f"{tmp_path}/w", split_bytes=size // 12)
    assert got.rdd.getNumPartitions() >= 12 and got.count() == 120
    assert len(set(got.rdd.mapPartitionsWithIndex(lambda i, rows: [i for _ in rows]).collect())) > 4
    assert read_warc(spark, f"{tmp_path}/w", split_bytes=size // 12, most_tasks=2).rdd.getNumPartitions() == 2


def test_an_empty_file_has_no_records(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"")
    assert read_warc(spark, f"{tmp_path}/w").count() == 0


@pytest.mark.parametrize("length", [b"5", b"abc", b"-3", b"", b"9" * 30, b"\xc2\xb2"])
def test_odd_lengths_and_names(spark, tmp_path, length):
    head = b"WARC/1.0\r\nwarc-type: resource\r\nWARC-RECORD-ID:<urn:a>\r\nContent-length: " + length + b"\r\nno colon here"
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(packed(head, b"hello") * 3)
    rows = read_warc(spark, f"{tmp_path}/w").collect()
    assert len(rows) == 3 and {(r.record_type, r.record_id, r.target_uri) for r in rows} == {("resource", "<urn:a>", None)}
    assert {bytes(r.payload)[:5] for r in rows} == {b"hello"}


def test_http_payloads():
    block = b"HTTP/1.1 200 OK\r\ncontent-length: 7\r\n\r\npayload"
    told = parse(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: Application/HTTP; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n")
    assert told["payload"] == b"payload" and told["payload_bytes"] == 7 and told["record_type"] == "response" and told["refers_to"] is None
    assert parse(b"WARC/1.1")["payload"] == b"" and warc._length({}, 4) == 4
