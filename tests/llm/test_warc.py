"""ARC lines of both versions, WARC files read back, the ids, and odd rows."""

import gzip
import io

import pytest
from pyspark.sql import functions as F

from ferrule.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def archive(version, *records):
    return warc.arc_version_block(version) + b"".join(warc.arc_record(version, u, c, 0) for u, c in records)


@pytest.mark.parametrize("version", [1, 2])
def test_declared_lengths_rule(version):
    inner = b"HTTP/1.1 200 OK\r\n\r\nhttp://x.y 0.0.0.0 20240101000000 text/html 3\nabc"
    found = list(warc.arc_records(archive(version, ("http://a.b/ c", inner), ("http://d.e/", b""))))
    assert [(f["url"], c) for f, c in found] == [("http://a.b/%20c", inner), ("http://d.e/", b"")]


@pytest.mark.parametrize("bad", [b"no header\n", archive(1, ("u", b"abc"))[:-3], b"http://a 0.0.0.0 20240101000000 text/html 1\nx\n"])
def test_broken_archives_are_errors(bad):
    with pytest.raises(ValueError):
        list(warc.arc_records(bad))


def test_broken_archives_are_rows(spark):
    good = archive(1, ("http://a/", b"HTTP/1.1 200 OK\r\n\r\nabc"), ("http://b/", b"x"))
    rows = [(bytearray(good),), (bytearray(good + b"http://c 0.0.0.0 20240101000000 text/html 99\nshort"),), (bytearray(b"nothing\n"),), (None,), (bytearray(b""),)]
    got = warc.convert(spark.createDataFrame(rows, "arc binary")).collect()
    assert sorted(r.uri for r in got if r.fault is None) == ["http://a/", "http://a/", "http://b/", "http://b/"]
    assert sorted(r.fault for r in got if r.fault) == ["no record header where one is due", "the archive ends inside a record"]


def test_broken_files_are_rows(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\nabc"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {warc.record_id(4, 'x')}\r\nWARC-Target-URI: u\r\nContent-Type: application/http\r\nWARC-Payload-Length: 3\r\n"
    good = (head + f"WARC-Payload-Digest: sha1:{warc.base32(__import__('hashlib').sha1(b'abc').digest())}\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    wrong = good.replace(b"abc", b"abd")
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "part-0.gz").write_bytes(gzip.compress(good + wrong))
    (tmp_path / "w" / "part-1.gz").write_bytes(gzip.compress(good + good[:-9]))
    (tmp_path / "w" / "part-2.gz").write_bytes(gzip.compress(good)[:-12])
    (tmp_path / "w" / "part-3.gz").write_bytes(b"no gzip")
    got = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert sum(r.page_id == 4 and r.fault is None for r in got) >= 2 and sum(r.fault == "a payload differs from its header" for r in got) == 1
    assert sum(r.page_id is None and r.fault is not None for r in got) == 3


def test_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    pages = spark.range(200).coalesce(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 1400)).alias("html"))
    monkeypatch.setattr(warc, "new_path", lambda *_: f"file://{tmp_path}/w")
    assert warc.archive_pages(pages).count() == 200
    assert len(list((tmp_path / "w").glob("part-*.gz"))) >= 15


def test_short_dates():
    assert warc.iso_date("19961231235959") == "1996-12-31T23:59:59Z"
    assert warc.iso_date("199612") == "1996-12-01T00:00:00Z"


@pytest.mark.parametrize("page", [0, 7, 2**62 + 5, -3, None])
def test_ids_hold_the_page(page, spark):
    made = warc.record_id(page, "a b")
    assert warc.page_of(made) == page
    if page is not None:
        assert spark.range(1).select(warc.record_id_sql(F.lit(page).cast("long"), F.lit("a b"))).first()[0] == made


def test_any_bytes_survive(spark, tmp_path):
    content = b"HTTP/1.1 200 OK\r\n\r\n\xff\x00\xfe\r\n\r\nWARC/1.1\r\n"
    arcs = spark.createDataFrame([(bytearray(archive(1, ("http://a/", content), ("http://b/", b"\x80plain"))),), (None,)], "arc binary")
    none = spark.createDataFrame([], "digest string, size long, page_id long, date string")
    warc.write_warc(warc.with_revisits(warc.convert(arcs), none), f"file://{tmp_path}/w")
    rows = {r.target_uri: r for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()}
    assert rows["http://a/"].payload_bytes == 3 + 4 + 10 and rows["http://a/"].record_type == "response"
    assert rows["http://b/"].payload_bytes == 6 and rows["http://b/"].record_type == "resource"


def test_odd_rows(spark):
    rows = [(3, "http://a/", "same", "x"), (1, None, "same", None), (1, "http://c/", "same", "y"), (None, "http://d/", "same", "z"), (5, "http://e/", None, "x"), (4, "", "", "x"), (9, "http://ü/ \n", "long " * 100_000, "x")]
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_pages(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted([(3, "revisit", 1, 4), (1, "response", None, 4), (1, "response", None, 4), (0, "response", None, 4), (5, "revisit", 4, 0), (4, "response", None, 0), (9, "response", None, 500_000)])
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_files_are_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x", ""), (2, "http://b/", "x", "")], SCHEMA)
    records = warc.convert(warc.pack_arc(pages))
    first = records.groupBy("digest", "size").agg(F.min("page_id").alias("page_id"), F.first("date").alias("date"))
    warc.write_warc(warc.with_revisits(records, first), f"file://{tmp_path}/w")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    found = list(warc.warc_records(io.BufferedReader(io.BytesIO(data))))
    ids = {h["warc-record-id"] for h, _ in found}
    (visit,) = [h for h, _ in found if h["warc-type"] == "revisit"]
    assert len(ids) == 2 and visit["warc-refers-to"] in ids and visit["warc-refers-to"] != visit["warc-record-id"]
