"""Legacy ARC archives to WARC: parse version-specific header lines and declared lengths, synthesise what WARC adds.

ARC 1 lines have five fields, ARC 2 lines ten; the archive's first record, filedesc, says which. Every record's length is
declared, so contents may hold anything. From a line come a WARC record's target, address, date (14 digits to ISO 8601) and
type (response if the content starts as HTTP, else resource); its identifier is a version 8 UUID that holds the page's number
and a hash of target, date and payload, so that reruns and lost executors yield the same; digests are SHA-1 in base 32.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm._shared import map_batches, new_path, shipped, written

shipped(__name__)

FIELDS = {1: ("url", "ip", "date", "type", "length"), 2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length")}
#: Bytes aimed at in a WARC file before compression: readers hold a file at a time.
FILE_BYTES = 32_000_000
#: Payload bytes aimed at in an archive that pack_arc makes, and the date and address of pages, which have none.
ARC_BYTES, DATE, ADDRESS = 4_000_000, "20240101000000", "0.0.0.0"
BREAK = "\r\n\r\n"


def header_value(text: str) -> str:
    """Spaces and control characters percent-encoded: a header line's field has none."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text) or "-"


def arc_version_block(version: int) -> bytes:
    body = f"{version} 0 ferrule\n".encode() + (b"URL IP-address Archive-date Content-type Archive-length\n" if version == 1 else b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n")
    fields = ["filedesc://pages.arc", ADDRESS, DATE, "text/plain", *(["200", "-", "-", "0", "pages.arc"] if version == 2 else []), str(len(body))]
    return " ".join(fields).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, content: bytes, offset: int) -> bytes:
    fields = [header_value(url), ADDRESS, DATE, "text/html", *(["200", "-", "-", str(offset), "pages.arc"] if version == 2 else []), str(len(content))]
    return " ".join(fields).encode() + b"\n" + content + b"\n"


def arc_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, content) of each record after the version block. A line of other fields than the version's is an error."""
    at, version = 0, None
    while at < len(archive):
        if archive[at] in b"\r\n":
            at += 1
            continue
        end = archive.find(b"\n", at)
        parts = archive[at:end].decode("utf-8", "replace").split(" ")
        if end < 0 or not parts[-1].strip().isdigit():
            raise ValueError("no record header where one is due")
        length, begin = int(parts[-1]), end + 1
        if begin + length > len(archive):
            raise ValueError("the archive ends inside a record")
        content = archive[begin : begin + length]
        at = begin + length
        if version is None:
            if not parts[0].startswith("filedesc:"):
                raise ValueError("an archive starts with its version block")
            version = int(content.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError("unknown version")
            continue
        names = FIELDS[version]
        if len(parts) < len(names):
            raise ValueError("too few fields")
        parts = [" ".join(parts[: len(parts) - len(names) + 1]), *parts[len(parts) - len(names) + 1 :]]  # old crawlers left spaces in URLs
        yield dict(zip(names, parts)), content


def payload_of(content: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload; no header if the content is not HTTP."""
    if content.startswith(b"HTTP/") and (m := re.search(rb"\r?\n\r?\n", content)):
        return content[: m.end()], content[m.end() :]
    return b"", content


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page: int | None, seed: str) -> str:
    """A version 8 UUID: 58 bits of a hash, whether there is a number, and its 64 bits."""
    number = (page or 0) & (2**64 - 1)
    h = int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "big")
    a, b, c = h >> 16 & (2**48 - 1), (int(page is not None) << 2 | number >> 62) & 0xFFF, number & (2**62 - 1)
    x = f"{a << 80 | 8 << 76 | b << 64 | 2 << 62 | c:032x}"
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def record_id_sql(page: Column, seed: Column) -> Column:
    """record_id of a page that has a number."""
    h, high, low = F.sha2(seed, 256), F.shiftrightunsigned(page, 62).bitwiseOR(4), page.bitwiseAND(2**62 - 1).bitwiseOR(F.lit(-(2**63)))
    part = lambda x, at, n: F.substring(x, at, n)
    tail = F.lower(F.hex(low))
    return F.concat(F.lit("<urn:uuid:"), part(h, 1, 8), F.lit("-"), part(h, 9, 4), F.lit("-8"), F.lpad(F.lower(F.hex(high)), 3, "0"), F.lit("-"), part(tail, 1, 4), F.lit("-"), part(tail, 5, 12), F.lit(">"))


def page_of(record: str) -> int | None:
    x = int(record.strip("<>").removeprefix("urn:uuid:").replace("-", ""), 16)
    b, c = x >> 64 & 0xFFF, x & (2**62 - 1)
    number = (b & 3) << 62 | c
    return number - (number >> 63 << 64) if b >> 2 & 1 else None


def iso_date(date: str) -> str:
    """14 digits, or fewer from the year on, as ISO 8601."""
    date = date + "00000101000000"[len(date) :] if len(date) < 14 else date
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def converted(fields: dict[str, str], content: bytes) -> dict:
    """What the WARC record of an ARC record has, before it is known whether it revisits another."""
    head, payload = payload_of(content)
    found = re.search(rb"(?mi)^X-Page-Id: (-?\d+)\r?$", head)
    page, iso = int(found[1]) if found else None, iso_date(fields["date"])
    digest = base32(hashlib.sha1(payload).digest())
    return {"page_id": page, "uri": fields["url"], "ip": fields["ip"], "date": iso, "http": head, "payload": payload, "digest": digest, "id": record_id(page, f"{iso} {digest}" if page is not None else f"{fields['url']} {iso} {digest}"), "mime": fields["type"]}


def pack_arc(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as ARC archives (column arc), versions 1 and 2 in turn, each of bounded size: what a legacy crawl would hold.

    A null URL is urn:none, a null html an empty payload; a null id has no X-Page-Id header.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made = 0
        for batch in batches:
            ids, urls, pages = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()))
            parts, size, version = [], 0, 1 + made % 2
            for i, page in enumerate(ids):
                body = pages[i].as_py() or b""
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {page}\r\n" if page is not None else "") + f"Content-Length: {len(body)}{BREAK}"
                parts.append(arc_record(version, "urn:none" if urls[i] is None else urls[i], head.encode() + body, size))
                size += len(parts[-1])
                if size >= ARC_BYTES or i + 1 == len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array([arc_version_block(version) + b"".join(parts)], pa.binary())], names=["arc"])
                    made, parts, size = made + 1, [], 0
                    version = 1 + made % 2

    return map_batches(df, [id_col, url_col, html_col], "arc binary", run)


RECORD = "page_id long, uri string, ip string, date string, mime string, id string, http binary, payload binary, digest string, size long, fault string"


def convert(arcs: DataFrame, arc_col: str = "arc") -> DataFrame:
    """One row per ARC record, with what its WARC record will say. Contents may hold any bytes; a null archive has no records.

    Where an archive is malformed, the records before that place stand, and one row says what is wrong (fault), as lengths
    can't be trusted from there on. No archive ends the job; write_warc leaves fault rows out.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        binary = {"http", "payload"}
        names = [c.split(" ")[0] for c in RECORD.split(", ")]
        kinds = [pa.int64() if n in ("page_id", "size") else pa.binary() if n in binary else pa.string() for n in names]
        for batch in batches:
            for i in range(batch.num_rows):
                archive, rows = batch.column(0)[i].as_py() or b"", []
                found, size = arc_records(archive), 0
                try:
                    for record in found:
                        rows.append(converted(*record) | {"fault": None})
                        size += len(rows[-1]["payload"])
                        if size >= ARC_BYTES:  # batches of bounded size
                            yield pa.RecordBatch.from_arrays([pa.array([len(r["payload"]) if n == "size" else r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)
                            rows, size = [], 0
                except ValueError as e:
                    rows.append(dict.fromkeys(names) | {"fault": str(e), "payload": b""})
                yield pa.RecordBatch.from_arrays([pa.array([len(r["payload"]) if n == "size" else r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

    return map_batches(arcs, [arc_col], RECORD, run)


def with_revisits(records: DataFrame, first: DataFrame, least: int = 0) -> DataFrame:
    """records with first_page and first_date: the response that each revisits, null for responses.

    first has digest, size, page_id, date: the least page of each payload met more than once. It is a written table, so its
    join's skew (one payload may be a third of all) is Spark's to split.
    """
    own = first.where(F.col("size") >= least).select(F.col("digest").alias("d"), F.col("page_id").alias("first_page"), F.col("date").alias("first_date"))
    joined = records.join(own, records.digest == F.col("d"), "left").drop("d")
    return joined.withColumn("first_page", F.when(F.col("first_page") == F.col("page_id"), None).when(F.col("page_id").isNull(), None).otherwise(F.col("first_page")))


def record_text(records: DataFrame) -> DataFrame:
    """value: a whole record, any bytes, without its last BREAK, which the writer puts after each."""
    revisit = F.col("first_page").isNotNull()
    http = F.length("http") > 0
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    kind = F.when(revisit, "revisit").when(http, "response").otherwise("resource")
    profile = F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record_id_sql(F.col("first_page"), F.concat_ws(" ", "first_date", "digest"))))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.col("id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, profile).otherwise(F.lit("")),
        line("Content-Type", F.when(http, "application/http; msgtype=response").otherwise(F.col("mime"))),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return records.select(F.concat(F.encode(head, "UTF-8"), block).cast("string").alias("value"))  # a cast keeps all bytes as they are


def write_warc(records: DataFrame, path: str, per_file: int = 20_000) -> None:
    """WARC files, gzip-compressed, by Spark's text writer: what stands between records is its line separator."""
    record_text(records.where("fault IS NULL")).write.option("lineSep", BREAK).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def warc_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no record where one is due")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("the archive ends inside a record")
        yield headers, block


def read_warc(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of the archives at path, as stored.

    A response's payload is measured and digested anew and must agree with its headers; a revisit has none, so its headers
    tell. A record that doesn't agree, and a file that ends or breaks inside a record, is a row whose fault says so.
    """

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        def row(headers, block):
            digest, size, kind = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["warc-payload-length"]), headers["warc-type"]
            fault = None
            if kind != "revisit":
                payload = payload_of(block)[1] if headers["content-type"].startswith("application/http") else block
                if (len(payload), base32(hashlib.sha1(payload).digest())) != (size, digest):
                    fault = "a payload differs from its header"
            return page_of(headers["warc-record-id"]), size, digest, kind, page_of(headers["warc-refers-to"]) if "warc-refers-to" in headers else None, headers["warc-target-uri"], headers["warc-record-id"], fault

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "record_id", "fault"]
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                try:
                    with gzip.GzipFile(fileobj=io.BytesIO(batch.column(0)[i].as_py())) as stream:
                        for headers, block in warc_records(io.BufferedReader(stream)):
                            rows.append(row(headers, block))
                except (ValueError, KeyError, EOFError, OSError, zlib.error) as e:
                    rows.append((None,) * 7 + (f"{type(e).__name__}: {e}",))
                cols = list(zip(*rows)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return map_batches(files, ["content"], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, record_id string, fault string", run)


def base32_sql(hex_digest):
    """A SHA-1 in hex as base 32: eight groups of 20 bits, four letters each."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    group = lambda i: F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("long")
    return F.concat(*(F.substr(F.lit(letters), F.shiftright(group(i), s).bitwiseAND(31) + 1, F.lit(1)) for i in range(8) for s in (15, 10, 5, 0)))


def archive_pages(df: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages to ARC, ARC to WARC files in the shared folder, and what these say when read back.

    Null html is an empty payload; null URLs become urn:none. A row with a null id is always a response and never one that
    others revisit. Repeated ids with equal payloads are all responses. An empty table gives an empty one; other columns are
    not read.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    light = df.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(payload).alias("x"), F.octet_length(payload).cast("long").alias("size"))
    first = light.groupBy("x", "size").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n")).where("n > 1 and page_id is not null")
    first = written(first.select(base32_sql(F.col("x")).alias("digest"), "size", "page_id", F.lit(iso_date(DATE)).alias("date")), "warc-first")
    mean = light.agg(F.avg(F.col("size") + 600)).first()[0]  # a record's headers take some 600 bytes
    path = new_path(df.sparkSession, "warc")
    write_warc(with_revisits(convert(pack_arc(df, id_col, url_col, html_col)), first, least), path, max(1, int(FILE_BYTES / (mean or 1))))
    return read_warc(df.sparkSession, path).where("fault IS NULL OR raise_error(fault) IS NULL")  # files just written must be whole


SQL = r"""
WITH p AS (SELECT page_id, url, sha1(coalesce(html, '')) AS x, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
q AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
             min(page_id) OVER (PARTITION BY x) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM q
"""
