import base64
import hashlib

import pytest

from motes.llm import archives as A

PAGES = [
    (1, "http://a/1", "<p>é same</p>"), (2, "http://a/2", "<p>é same</p>"), (3, "http://a b/3", ""), (4, None, None), (5, "http://a/5", "\r\n\r\nWARC/1.1\r\n\r\nodd\r\n\r\n"),
    (6, "http://a/6", "x" * 200_000), (7, "http://a/7", "one\x00\n"), (7, "http://a/7", "one\x00\n"), (7, "http://a/7", "other"), (8, "u", "other"), (None, "n", "alone"), (None, "n", "other"),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as record", "3 as n")


def expected(rows):
    top = {}
    for page, _, html in rows:
        if page is not None:
            top[html or ""] = max(top.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        first = top.get(html or "")
        again = first is not None and page != first
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page, len(raw), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_awkward_and_given_pages(spark, monkeypatch):
    monkeypatch.setattr(A, "RECORDS_A_FILE", 5)
    got = A.archived(frame(spark))
    assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=repr) == expected(PAGES)
    assert {r.payload_digest: bytes(r.payload).decode() for r in got.where("record_type = 'response'").collect()} == {
        A.payload_digest((h or "").encode()): h or "" for _, _, h in PAGES
    }
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in A.archived(pages).select(COLUMNS).collect()), key=repr) == expected(rows)


def test_both_arc_versions():
    captures = [A.Capture("http://x/", "1.2.3.4", "20010203040506", "text/html", A.http_block(9, b"a\n\nb")), A.Capture("http://y/", "0.0.0.0", "2001", "text/plain", b"")]
    for version in (1, 2):
        back = list(A.parse_arc(A.arc_file(captures, version)))
        assert [c[:5] for c in back] == [c[:5] for c in captures]
    ((headers, block),) = A.parse_warc(A.warc_record(captures[0]) + b"\r\n\r\n")
    assert headers["warc-date"] == "2001-02-03T04:05:06Z" and block == captures[0].block
    assert headers["warc-record-id"].startswith("<urn:uuid:")


def test_broken_archives():
    good = A.arc_file([A.Capture("http://x/", "1.2.3.4", "20010203040506", "text/html", b"body")])
    for bad in (good[:-3], good.replace(b"text/html", b"text /html"), b"http://x/ 1 2 3 4\nbody", good.replace(b"1 0 motes", b"7 0 motes")):
        with pytest.raises(ValueError):
            list(A.parse_arc(bad))


def test_empty(spark):
    assert A.archived(frame(spark).limit(0)).count() == 0
