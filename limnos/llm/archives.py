"""Legacy web archives (ARC, versions 1 and 2) turned into WARC 1.0.

An archive is written as one row of a text writer that puts a single record in a file, so that file sizes are bounded
by ``ARCHIVE_BYTES`` whatever the partitions hold, and any store that Spark writes to will do. Reading takes whole
(bounded) files and steps from record to record by the declared lengths; nothing is searched for in payloads.

The converter synthesises what ARC lacks: a record identifier (from URL, date, key and digest, so that a repeated task
writes the same one), an ISO timestamp, the record type and SHA-1 digests in base32. Of the records with equal payloads
of at least ``revisit_bytes`` bytes, the one with the largest key is the response and the others revisit it.

Defined results: a null payload is an empty one; a null key stays null and never becomes a response while a record with
a key has the payload; repeated rows with the largest key are all responses; a null URL is written as "-" and read as
null; white space and control characters in URLs are percent-encoded; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm.registry import query, table
from limnos.session import scratch_path

ARCHIVE_BYTES = 16 << 20
# Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_EPOCH = datetime(2001, 1, 1, tzinfo=timezone.utc)
_KEY = "X-Page-Id"
_CAPTURE = "key long, url string, date string, ip string, mime string, head string, payload binary, digest string"
_RESULT = "key long, url string, date string, record_type string, record_id string, payload_bytes long, payload_digest string, refers_to long"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def _inflated(data: bytes) -> bytes:
    """Every member of a gzip file, or the bytes as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(data) + z.flush())
        data = z.unused_data
    return b"".join(out) + (data if not out else b"")


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    fields = [f"filedesc://{name}", "0.0.0.0", _EPOCH.strftime("%Y%m%d%H%M%S"), "text/plain"]
    fields += ["200", "-", "-", "0", name] if version == 2 else []
    return f"{' '.join(fields)} {len(body)}\n".encode() + body


def arc_record(version: int, name: str, offset: int, key: int | None, url: str | None, payload: bytes) -> bytes:
    """A capture as ARC holds it: the header line and an HTTP response of the declared length."""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n"
    head += f"{_KEY}: {key}\r\n\r\n" if key is not None else "\r\n"
    date = (_EPOCH + timedelta(seconds=(key or 0) % 631_152_000)).strftime("%Y%m%d%H%M%S")
    fields = [plain_url(url), "0.0.0.0", date, "text/html"] + (["200", digest32(payload), "-", str(offset), name] if version == 2 else [])
    body = head.encode() + payload
    return f"{' '.join(fields)} {len(body)}\n".encode() + body


def read_arc(data: bytes) -> Iterator[dict[str, str | bytes]]:
    """Fields and body of each record after the version block, by that block's own list of fields; none of an empty file."""
    data = _inflated(data)
    if not data:
        return

    def step(at: int, names: list[str] | None) -> tuple[dict, int]:
        end = data.index(b"\n", at)
        cells = data[at:end].decode("utf-8", "replace").split(" ")
        size = int(cells[-1])
        row: dict = dict(zip(names, cells, strict=True)) if names else {}
        row["body"] = data[end + 1 : end + 1 + size]
        if len(row["body"]) != size:
            raise ValueError(f"archive cut short: {size} bytes declared, {len(row['body'])} there")
        return row, end + 1 + size

    first, at = step(0, None)
    about, names = first["body"].decode().split("\n")[:2]
    version = int(about.split(" ")[0])
    if names != ARC_FIELDS.get(version):
        raise ValueError(f"unknown ARC version or fields: {about!r} {names!r}")
    while True:
        while data[at : at + 1] == b"\n":
            at += 1
        if at >= len(data):
            return
        row, at = step(at, names.split(" "))
        yield row


def warc_record(kind: str, headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{digest32(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record."""
    data, at = _inflated(data), 0
    while True:
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"archive cut short: {size} bytes declared, {len(block)} there")
        yield headers, block
        at = end + 4 + size


def _http(body: bytes) -> tuple[str, bytes, dict[str, str]]:
    head, _, payload = body.partition(b"\r\n\r\n")
    text = head.decode("utf-8", "replace")
    return text, payload, dict(x.split(": ", 1) for x in text.split("\r\n")[1:] if ": " in x)


def _archives(rows: Iterator[tuple], first, record) -> Iterator[pa.RecordBatch]:
    """Archives of bounded size: first(number) opens one, record(number, offset, row) adds to it."""
    number, parts, size = 0, [], 0
    for row in rows:
        if not parts:
            parts, size = [first(number)], 0
            size = len(parts[0])
        parts.append(record(number, size, row))
        size += len(parts[-1])
        if size >= ARCHIVE_BYTES:
            yield pa.RecordBatch.from_pydict({"value": pa.array([b"".join(parts)], pa.binary())})
            number, parts = number + 1, []
    if parts:
        yield pa.RecordBatch.from_pydict({"value": pa.array([b"".join(parts)], pa.binary())})


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _save(archives: DataFrame, path: str) -> str:
    """One file for each row; the fast gzip level costs a third of the CPU of the default one and a tenth more disk."""
    archives.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> str:
    """Captures as ARC files; even tasks write version 1, odd ones version 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        version = 1 + task % 2

        def record(number: int, offset: int, row: tuple) -> bytes:
            return arc_record(version, f"{task}-{number}.arc", offset, row[0], row[1], (row[2] or "").encode()) + b"\n"

        yield from _archives(_cells(batches), lambda number: arc_version_block(version, f"{task}-{number}.arc") + b"\n", record)

    rows = pages.select(F.col(key).cast("long"), F.col(url), F.col(payload))
    return _save(rows.mapInArrow(run, "value binary"), path)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all ARC files below a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (data,) in _cells(batches):
            rows: list[tuple] = []
            size = 0
            for r in read_arc(data):
                head, payload, http = _http(r["body"])
                when = datetime.strptime(r["Archive-date"], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
                key = http.get(_KEY)
                rows.append((None if key is None else int(key), None if r["URL"] == "-" else r["URL"], when, r["IP-address"], r["Content-type"], head, payload, digest32(payload)))
                size += len(payload)
                if size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _CAPTURE.split(", ")])

    return _files(spark, path).mapInArrow(run, _CAPTURE)


def record_id(url: str, date: str, key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{url} {date} {key} {digest}'.encode()).digest()[:16], version=4)}>"


def convert(arc: DataFrame, path: str, revisit_bytes: int = 0) -> str:
    """WARC files of all captures."""
    # Keys and digests alone meet at a payload that many share; payloads are dealt out by key.
    about = arc.select("key", "url", "date", "digest", F.length("payload").alias("size"))
    kept = about.filter(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.max(F.struct("key", "url", "date")).alias("kept"))
    a, k = about.select("key", "digest").distinct().alias("a"), kept.alias("k")
    turned = a.join(k, "digest").filter(~F.col("key").eqNullSafe(F.col("kept.key"))).select(F.col("key").alias("t_key"), F.col("digest").alias("t_digest"), "kept")
    rows = arc.join(turned, F.col("key").eqNullSafe(F.col("t_key")) & (F.col("digest") == F.col("t_digest")), "left")
    rows = rows.select("key", "url", "date", "ip", "head", "digest", F.when(F.col("kept").isNull(), F.col("payload")).alias("payload"), F.col("kept.key").alias("to_key"), F.col("kept.url").alias("to_url"), F.col("kept.date").alias("to_date"), F.col("kept").isNotNull().alias("revisit"))

    def info(number: int) -> bytes:
        name = f"{TaskContext.get().partitionId()}-{number}.warc"
        about = [("WARC-Record-ID", record_id(name, "", None, "")), ("WARC-Date", _EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ")), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
        return warc_record("warcinfo", about, b"format: WARC File Format 1.0\r\n")

    def record(number: int, offset: int, row: tuple) -> bytes:
        key, url, date, ip, head, digest, payload, to_key, to_url, to_date, revisit = row
        headers = [("WARC-Record-ID", record_id(url or "-", date, key, digest)), ("WARC-Target-URI", url or "-"), ("WARC-Date", date), ("WARC-IP-Address", ip), ("WARC-Payload-Digest", f"sha1:{digest}")]
        if revisit:
            headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(to_url or "-", to_date, to_key, digest)), ("WARC-Refers-To-Target-URI", to_url or "-"), ("WARC-Refers-To-Date", to_date)]
            headers += [("WARC-Refers-To-" + _KEY, str(to_key))]
        headers.append(("Content-Type", "application/http; msgtype=response"))
        return warc_record("revisit" if revisit else "response", headers, f"{head}\r\n\r\n".encode() + (payload or b""))

    return _save(rows.mapInArrow(lambda batches: _archives(_cells(batches), info, record), "value binary"), path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """What all WARC files below a path hold, with the digests of payloads at hand checked again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RESULT.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for (data,) in _cells(batches):
            rows = []
            for h, block in read_warc(data):
                if h["WARC-Type"] == "warcinfo":
                    continue
                _, payload, http = _http(block)
                digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                if h["WARC-Type"] == "response" and (digest32(payload) != digest or len(payload) != size):
                    raise ValueError(f"record {h['WARC-Record-ID']} does not hold the payload it declares")
                key, to = http.get(_KEY), h.get("WARC-Refers-To-" + _KEY)
                url = h["WARC-Target-URI"]
                rows.append((None if key is None else int(key), None if url == "-" else url, h["WARC-Date"], h["WARC-Type"], h["WARC-Record-ID"], size, digest, None if to is None else int(to)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _files(spark, path).mapInArrow(run, _RESULT)


@query("op10_warc")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ARC and WARC files and back."""
    arc = write_arc(table(spark, sf_dir, "pages"), scratch_path(spark, "arc"))
    warc = convert(captures(spark, arc), scratch_path(spark, "warc"))
    return records(spark, warc).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")
