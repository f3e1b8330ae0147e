import base64
import gzip
import hashlib

import pytest

from limnos.llm import archives
from limnos.session import scratch_path

PAGES = [
    (1, "http://a/1", "<p>same</p>"),
    (2, "http://a/2 with space", "<p>same</p>"),
    (3, None, "<p>same</p>"),
    (4, "http://a/4", None),
    (5, "", ""),
    (6, "http://a/6", "WARC/1.0\r\n\r\nContent-Length: 5\r\n\r\n\nhttp://x 0.0.0.0 1 t 3\n é"),
    (6, "http://a/6", "WARC/1.0\r\n\r\nContent-Length: 5\r\n\r\n\nhttp://x 0.0.0.0 1 t 3\n é"),
    (7, "http://a/7", "long " * 200_000),
    (None, "http://a/8", "<p>same</p>"),
    (None, "http://a/9", "no key"),
]
SCHEMA = "page_id long, url string, html string, key string, digest string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", "y") for p in PAGES], SCHEMA).repartition(3)


def through(spark, pages, **options):
    arc = archives.write_arc(pages, scratch_path(spark, "arc"))
    return archives.records(spark, archives.convert(archives.captures(spark, arc), scratch_path(spark, "warc"), **options)).collect()


def test_pages_come_back_with_types_and_digests(spark, pages):
    got = through(spark, pages)
    assert len(got) == len(PAGES)
    for key, _, html in PAGES:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        keys = [k for k, _, h in PAGES if (h or "").encode() == body and k is not None]
        kept = max(keys, default=None)
        for r in (r for r in got if r["key"] == key and r["payload_digest"] == digest):
            assert r["payload_bytes"] == len(body)
            assert (r["record_type"], r["refers_to"]) == (("response", None) if key == kept else ("revisit", kept))
        assert any(r["key"] == key and r["payload_digest"] == digest for r in got)


def test_small_payloads_need_not_be_revisits(spark, pages):
    got = through(spark, pages, revisit_bytes=50)
    assert {r["record_type"] for r in got if r["payload_bytes"] < 50} == {"response"}


def test_archives_are_bounded_and_repeatable(spark, pages, monkeypatch):
    monkeypatch.setattr(archives, "ARCHIVE_BYTES", 200)
    first, again = through(spark, pages), through(spark, pages)
    assert sorted(map(str, first)) == sorted(map(str, again)) and len({r["record_id"] for r in first}) == len(PAGES) - 1


def test_both_versions_and_broken_files():
    for version in (1, 2):
        data = archives.arc_version_block(version, "f.arc") + b"\n" + archives.arc_record(version, "f.arc", 0, 7, "http://a", b"x\ny") + b"\n"
        for form in (data, gzip.compress(data), gzip.compress(data[:40]) + gzip.compress(data[40:])):
            (r,) = archives.read_arc(form)
            assert r["URL"] == "http://a" and r["body"].endswith(b"\r\n\r\nx\ny")
        with pytest.raises(ValueError, match="cut short"):
            list(archives.read_arc(data[:-3]))
    with pytest.raises(ValueError, match="unknown ARC version"):
        list(archives.read_arc(archives.arc_version_block(1, "f").replace(b"\n1 0", b"\n9 0")))


def test_empty_table(spark, pages):
    assert through(spark, pages.limit(0)) == []
