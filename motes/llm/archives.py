"""Legacy web archives (ARC) converted to WARC, and WARC files written and read back by Spark.

An ARC file opens with a version block, a record of its own whose body names the version and the fields
of the header lines that follow: five for version 1, ten for version 2. Each header line ends with the
declared length of the bytes after it. The converter parses lines and lengths, then synthesises what
WARC asks for beyond them: record ids, ISO timestamps, types and digests.

Of records with equal payloads the one with the largest page id is a response and the rest revisit it.
That is decided over digests alone: a shuffle of small rows, pre-aggregated, so a payload that a third
of all pages share costs one row a task. WARC files are written by Spark's text writer, whose line end is
a record's end, as gzip in a folder that all executors share, and read back as whole binary files of
bounded record counts.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import new_path, written

#: Records of one WARC file at most, so that reading a file whole stays small.
RECORDS_A_FILE = 1000
#: ARC versions and their header fields, fixed by the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NO_IP, NO_VALUE = "0.0.0.0", "-"
#: The date of records that carry none.
NO_DATE = "19700101000000"
_SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class Capture(NamedTuple):
    """A record as an archive holds it; ``block`` is the HTTP message."""

    url: str
    ip: str
    date: str
    content_type: str
    block: bytes
    checksum: str | None = None


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_file(captures: list[Capture], version: int = 1, name: str = "pages.arc") -> bytes:
    """ARC bytes of some captures under a version block."""
    body = f"{version} 0 motes\n{FIELDS[version]}\n".encode()
    parts = [f"filedesc://{name} {NO_IP} {NO_DATE} text/plain {len(body)}\n".encode(), body, b"\n"]
    if version == 2:
        parts[0] = f"filedesc://{name} {NO_IP} {NO_DATE} text/plain 200 - - 0 {name} {len(body)}\n".encode()
    for c in captures:
        url, kind = re.sub(r"\s", "%20", c.url) or NO_VALUE, re.sub(r"\s", "", c.content_type) or NO_VALUE
        middle = f" 200 {c.checksum or NO_VALUE} - {sum(map(len, parts))} {name}" if version == 2 else ""
        parts += [f"{url} {c.ip} {c.date} {kind}{middle} {len(c.block)}\n".encode(), c.block, b"\n"]
    return b"".join(parts)


def parse_arc(raw: bytes) -> Iterator[Capture]:
    """The captures of an ARC file of either version, by their declared lengths.

    A length beyond the end of the file, or a line with the wrong number of fields, raises ValueError.
    """
    at, fields = 0, None
    while at < len(raw):
        if raw[at : at + 1] == b"\n":
            at += 1
            continue
        end = raw.find(b"\n", at)
        line = raw[at : end if end >= 0 else len(raw)].decode("utf-8", "replace").rstrip("\r").split(" ")
        if fields is not None and len(line) != len(fields):
            raise ValueError(f"{len(line)} fields in an ARC header line of {len(fields)}: {line[:2]}")
        length = int(line[-1])
        start, at = end + 1, end + 1 + length
        if end < 0 or at > len(raw):
            raise ValueError(f"an ARC record declares {length} bytes, more than the file holds: {line[:2]}")
        body = raw[start:at]
        if fields is None:
            if not line[0].startswith("filedesc:"):
                raise ValueError("an ARC file has to open with its version block")
            version, names = body.split(b"\n")[:2]
            fields = names.decode().split(" ")
            if fields != FIELDS.get(int(version.split(b" ")[0]), "").split(" "):
                raise ValueError(f"ARC version {version.decode()!r} with the fields {fields}")
            continue
        by = dict(zip(fields, line, strict=True))
        yield Capture(by["URL"], by["IP-address"], by["Archive-date"], by["Content-type"], body, by.get("Checksum"))


def http_block(page_id: int | None, payload: bytes) -> bytes:
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n%sContent-Length: %d\r\n\r\n%s" % (own, len(payload), payload)


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of an HTTP message; a block without one is all payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return {}, block
    pairs = (line.split(":", 1) for line in head.decode("latin-1").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}, payload


def iso_date(date: str) -> str:
    return datetime.strptime(date.ljust(14, "0")[:14], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(url: str, date: str, page_id: int | None) -> str:
    """The same id whenever a capture is converted: a name-based UUID."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE_ID, f'{date} {page_id} {url}')}>"


def warc_record(c: Capture, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """The WARC record of a capture, without the two line ends that close it.

    A revisit keeps the HTTP headers, the digest and the length of the payload it leaves out.
    """
    headers, payload = split_http(c.block)
    page = int(headers["x-page-id"]) if "x-page-id" in headers else None
    block = c.block[: len(c.block) - len(payload)] if revisit else c.block
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(c.url, c.date, page)}",
        f"WARC-Date: {iso_date(c.date)}",
        f"WARC-Target-URI: {c.url}",
        f"WARC-IP-Address: {c.ip}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        f"WARC-Identified-Payload-Type: {c.content_type}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of the records of a WARC file; gzip is undone first."""
    while raw[:2] == b"\x1f\x8b":
        parts = []
        while raw:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(raw))
            raw = member.unused_data
        raw = b"".join(parts)
    at = 0
    while at < len(raw):
        gap = raw.find(b"\r\n\r\n", at)
        if gap < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        pairs = (line.split(": ", 1) for line in raw[at:gap].decode().split("\r\n")[1:])
        headers = {k.lower(): v for k, v in pairs}
        start = gap + 4
        at = start + int(headers["content-length"])
        yield headers, raw[start:at]
        if raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a WARC record is not closed at byte {at}")
        at += 4


def _pages(batch: pa.RecordBatch) -> Iterator[tuple[int, int | None, str, bytes]]:
    ids = batch.column(0).to_pylist()
    for k, (page, url, html) in enumerate(zip(ids, batch.column(1), batch.column(2), strict=True)):
        yield k, page, url.as_py() or NO_VALUE, html.as_buffer().to_pybytes() if html.is_valid else b""


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [payload_digest(html) for _, _, _, html in _pages(batch)]
        yield pa.record_batch([batch.column(0), pa.array(digests, pa.string())], ["page_id", "digest"])


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages become an ARC file a batch of up to 200; its parsed captures become WARC records."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            arc = arc_file([Capture(url, NO_IP, NO_DATE, "text/html", http_block(page, html)) for _, page, url, html in _pages(part)])
            refers, revisits = part.column(3).to_pylist(), part.column(4).to_pylist()
            records = [warc_record(c, refers[k], revisits[k]) for k, c in enumerate(parse_arc(arc))]
            yield pa.record_batch([pa.array(records, pa.binary())], ["record"])


def write_warc(pages: DataFrame, folder: str) -> None:
    """A WARC record for every row of ``pages`` (page_id, url, html) into ``folder``."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("binary").alias("html"))
    digests = written(pages.select("page_id", "url", "html").mapInArrow(_digests, "page_id long, digest string"), "digests")
    shared = digests.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1")
    moved = digests.join(shared, "digest").where("page_id is null or page_id < top").select(F.col("page_id").alias("id"), "digest", "top").distinct()
    own = pages.withColumn("own", _base32(F.sha1(F.coalesce("html", F.lit(b"")))))
    decided = own.join(moved, own.page_id.eqNullSafe(F.col("id")) & (F.col("own") == F.col("digest")), "left")
    records = decided.select("page_id", "url", "html", F.col("top").alias("refers_to"), F.col("top").isNotNull().alias("revisit")).mapInArrow(
        _converted, "record binary"
    )
    (
        records.select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(folder)
    )


def _base32(hexed):
    """Upper-case base32 of a 40-digit hexadecimal column: eight groups of twenty bits, four letters each."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for group in range(8):
        bits = F.conv(F.substring(hexed, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            out.append(F.substring(F.lit(letters), place, F.lit(1)))
    return F.concat(*out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("record_type", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ])
    for batch in batches:
        for raw in batch.column(0):
            rows = []
            for h, block in parse_warc(raw.as_buffer().to_pybytes()):
                http, payload = split_http(block)
                kind, refers = h["warc-type"], h.get("x-refers-to-page")
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and (digest != payload_digest(payload) or len(payload) != int(h["x-payload-length"])):
                    raise ValueError(f"the payload of {h['warc-record-id']} is not what its record declares")
                page = int(http["x-page-id"]) if "x-page-id" in http else None
                rows.append((page, h["warc-target-uri"], h["warc-record-id"], h["warc-date"], kind, int(h["x-payload-length"]), digest, int(refers) if refers and refers != "None" else None, payload if kind == "response" else None))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


READ = (
    "page_id long, url string, record_id string, date string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, payload binary"
)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row for every record of the WARC files in ``folder``; each response's digest and length are verified."""
    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(_read, READ)


def archived(pages: DataFrame) -> DataFrame:
    """``pages`` written as WARC through the ARC converter and read back.

    A null html is an empty payload; a null url is ``-``; white space in a url is percent-encoded, as a
    header line needs; rows with a null page id revisit a payload's largest id if it has one. Equal rows
    are a record each. An empty table makes an empty archive.
    """
    folder = new_path(pages.sparkSession, "warc")
    write_warc(pages, folder)
    return read_warc(pages.sparkSession, folder)


#: Fixed SQL of the contract: DuckDB has no base32, so the digest's letters are built from its bits.
SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
d as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, h,
    max(page_id) over (partition by h) as top,
    array_to_string(list_transform([k for k in range(0, 32)],
        lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast(concat('0x', substr(h, 5 * (k // 4) + 1, 5)) as bigint) >> (5 * (3 - k % 4))) & 31) + 1, 1)), '') as payload_digest from p)
select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type,
    case when page_id = top then null else top end as refers_to from d
"""
