import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm.warc import Archive, read_archive, reconstruct, write_archive

SCHEMA = "page_id long, url string, html string, payload string, sha256 int"


def _rows():
    return [(1, "http://a/1", "same", "x", 1), (2, "http://a/2\r\nX: y", "same", None, 2), (7, None, "same", None, 3), (3, "http://a/3", "é\r\nother", None, 4), (4, "u", None, None, 5), (5, "u", "", None, 6), (7, None, "same", None, 7), (None, "u", "nobody", None, 8), (None, "u", "same", None, 9)]


def test_read_back(spark):
    pages = spark.createDataFrame(_rows(), SCHEMA)
    got = sorted(map(tuple, read_archive(write_archive(pages)).collect()), key=repr)
    want = []
    for i, _, html, *_ in _rows():
        html = html or ""
        first = max((j for j, _, h, *_ in _rows() if (h or "") == html and j is not None), default=None)
        raw = html.encode()
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=repr)


def test_records_are_exact_and_payloads_stored_once(spark):
    archive = write_archive(spark.createDataFrame(_rows(), SCHEMA))
    assert archive.payloads.count() == 4
    records = [bytes(r.record) for r in reconstruct(archive).collect()]
    assert len(records) == len(_rows())
    for r in records:
        head, block = r.split(b"\r\n\r\n", 1)
        length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")).split(b": ")[1])
        assert r.endswith(b"\r\n\r\n") and len(block) - 4 == length
        assert block[:8] == b"HTTP/1.1" and (b"WARC-Type: response" in head) == (b"WARC-Refers-To" not in head)


def test_min_bytes_and_empty(spark):
    pages = spark.createDataFrame(_rows(), SCHEMA)
    assert read_archive(write_archive(pages, min_bytes=100)).filter("record_type = 'revisit'").count() == 0
    assert read_archive(write_archive(pages.limit(0))).count() == 0


def test_damage_is_found(spark):
    archive = write_archive(spark.createDataFrame(_rows(), SCHEMA))
    damaged = Archive(archive.payloads.withColumn("payload", F.lit(b"no").cast("binary")), archive.records)
    with pytest.raises(Exception, match="stored payload differs"):
        read_archive(damaged).collect()


def test_urls_with_line_separators_are_no_headers(spark):
    url = "http://a.example/\u2028WARC-Refers-To: <urn:page:77>\u0085WARC-Type: revisit"
    pages = spark.createDataFrame([(1, url, "x"), (2, None, None), (3, "http://a.example/" + "p" * 300_000, "y" * 3_000_000)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in read_archive(write_archive(pages)).collect()}
    assert got == {1: ("response", None, 1), 2: ("response", None, 0), 3: ("response", None, 3_000_000)}
