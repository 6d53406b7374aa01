"""WARC archives: a writer of gzip members, and a reader that salvages what it can from damaged files.

The writer makes one record, in a gzip member of its own, of each row. Payloads of at least `LEAST` bytes that
several rows share are stored once: the row with the largest key is the response, the others are revisits that refer
to it. Rows that tie for the largest key are all responses; a null key is smaller than any other.

The reader checks each member (its checksum, the version line, the header, the block's length and digest). Where
a check fails, it looks for the next gzip member or version line that begins a valid record, goes on there, and logs
the bytes between as a gap. Records and gaps together cover every byte of a file.

Members are written by Spark's text writer, whose commit survives lost executors, and read as binary files, so
archives can be in any store that Spark reaches. A member always ends in a zero byte (the high byte of its length; one
of 16 MB or more gets an empty member after it), which is the writer's line separator: nothing comes between members.

Defined results: a null payload is empty; rows that repeat a key with equal payloads are written each; an empty table
gives an empty archive; other columns, whatever their names, are not read; an empty file holds no record and no gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._cluster import batches, column, cut, drop, shared_dir

#: The least bytes of payloads that are stored once.
LEAST = 1000
#: Records in a file, at most.
RECORDS = 1000
#: Groups of equal payloads are broadcast up to this many (about 100 bytes each); beyond, they are joined by shuffle.
MAX_BROADCAST_GROUPS = 100_000
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, key: object, url: str | None, payload: bytes, length: int, digest: str, refers_to: object = None) -> bytes:
    """A whole record. A revisit has the HTTP header of its response, but not the payload; digest is hex SHA-1."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{quote(str(key))}>"), ("WARC-Date", DATE)]
    if url is not None:
        lines.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    lines += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("WARC-Block-Digest", "sha1:" + _sha1(block))]
    if kind == "revisit":
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{quote(str(refers_to))}>")]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that ends in a zero byte."""
    made = gzip.compress(data, 6, mtime=0)
    return made if made[-1] == 0 else made + gzip.compress(b"", mtime=0)


@dataclass
class Found:
    """A record, or where error is set a gap, of length bytes at offset of a file."""

    offset: int
    length: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    error: str | None = None

    @property
    def payload(self) -> bytes:
        """The block without its HTTP header."""
        return self.block.partition(b"\r\n\r\n")[2] if self.block.startswith(b"HTTP/") else self.block


class _Bad(ValueError):
    pass


def _parsed(data: bytes, at: int, whole: bool) -> Found:
    """The record at data[at:], if it passes all checks. whole: nothing may follow it."""
    line = _VERSION_LINE.match(data, at)
    if not line:
        raise _Bad("no version line")
    end = data.find(b"\r\n\r\n", line.end() - 2)
    if end < 0:
        raise _Bad("header without an end")
    headers: dict[str, str] = {}
    for x in data[line.end() : end].split(b"\r\n"):
        name, colon, value = x.partition(b":")
        if not colon or not name.strip():
            raise _Bad("bad header line")
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdecimal() or "warc-type" not in headers or "warc-record-id" not in headers:
        raise _Bad("header without type, id or length")
    start = end + 4
    stop = start + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise _Bad("block of another length")
    block = data[start:stop]
    if (said := headers.get("warc-block-digest")) is not None and said.lower().startswith("sha1:") and said[5:].upper() != _sha1(block):
        raise _Bad("block of another digest")
    if whole and stop + 4 != len(data):
        raise _Bad("more than a record in a member")
    return Found(at, stop + 4 - at, headers, block)


def _one(data: bytes, at: int) -> Found:
    """The valid record, as plain bytes or a member, at data[at:]; without headers for an empty member."""
    if data.startswith(VERSION, at):
        return _parsed(data, at, False)
    if not data.startswith(MAGIC, at):
        raise _Bad("neither a member nor a version line")
    unpack = zlib.decompressobj(31)
    try:
        got = [unpack.decompress(memoryview(data)[at : at + 65536])]
        end = at + 65536
        while not unpack.eof and end < len(data):
            got.append(unpack.decompress(memoryview(data)[end : end + 65536]))
            end += 65536
    except zlib.error as e:
        raise _Bad(f"bad member: {e}") from None
    if not unpack.eof:
        raise _Bad("member without an end")
    size = min(end, len(data)) - at - len(unpack.unused_data)
    plain = b"".join(got)
    if not plain:
        return Found(at, size)
    inner = _parsed(plain, 0, True)
    return Found(at, size, inner.headers, inner.block)


def salvaged(data: bytes) -> Iterator[Found]:
    """All valid records of a file's bytes and the gaps between them, in order."""
    at, bad, why = 0, None, ""
    while at < len(data):
        try:
            found = _one(data, at)
        except _Bad as e:
            if bad is None:
                bad, why = at, str(e)
            further = _NEXT.search(data, at + 1)
            at = further.start() if further else len(data)
            continue
        if bad is not None:
            yield Found(bad, at - bad, error=why)
            bad = None
        if found.headers:
            yield found
        at += found.length
    if bad is not None:
        yield Found(bad, len(data) - bad, error=why)


def write(rows: DataFrame, path: str, key: str, payload: str, url: str | None = None) -> None:
    """Write an archive of rows into the folder path."""
    spark = rows.sparkSession
    rows = rows.select(column(rows, key).alias("key"), (column(rows, url) if url else F.lit(None).cast("string")).alias("url"), F.coalesce(column(rows, payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    groups = rows.where(F.col("n") >= LEAST).groupBy("digest").agg(F.max("key").alias("first"), F.count("*").alias("copies")).where("copies > 1").select(F.col("digest").alias("_digest"), "first")
    groups, _ = cut(groups, "equal-payloads")
    if groups.count() <= MAX_BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    rows = rows.join(groups, F.col("digest") == F.col("_digest"), "left").select("key", "url", "payload", "digest", "n", "first", F.col("_digest").isNotNull().alias("shared"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                revisit = r["shared"] and r["key"] != r["first"]
                text = record("revisit" if revisit else "response", r["key"], r["url"], r["payload"].encode(), r["n"], r["digest"], r["first"])
                out.append(member(text)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    members = rows.mapInArrow(made, "member binary").select(F.col("member").cast("string").alias("value"))
    with batches(spark, 200):
        members.write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS).text(path)


_READ = "path string, offset long, length long, error string, warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, http_length long, payload binary"
_HTTP_LENGTH = re.compile(rb"(?im)^content-length:\s*(\d+)\s*$")


def _plain_digest(said: str | None) -> str | None:
    """Bare lower-case hex of a base-32 (or hex) SHA-1."""
    if said is None or not said.lower().startswith("sha1:"):
        return None
    value = said[5:]
    try:
        return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()
    except ValueError:
        return None


def _row(path: str, f: Found) -> dict:
    head = f.block.partition(b"\r\n\r\n")[0] if f.block.startswith(b"HTTP/") else b""
    length = _HTTP_LENGTH.search(head.replace(b"\r", b""))
    h = f.headers
    return {
        "path": path, "offset": f.offset, "length": f.length, "error": f.error, "warc_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"),
        "refers_to": h.get("warc-refers-to"), "payload_digest": _plain_digest(h.get("warc-payload-digest")), "http_length": int(length[1]) if length else None, "payload": None if f.error is not None else f.payload,
    }


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each valid record and, with error set, for each gap of the archives in the folder path. Jobs on large archives run within batches(spark, 1)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _READ.split(", "))])
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                held: list[dict] = []
                size = 0
                for f in salvaged(content):
                    held.append(_row(name, f))
                    size += len(f.block)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return files.mapInArrow(parsed, _READ)


def gaps(found: DataFrame) -> DataFrame:
    """The log of quarantined bytes: (path, offset, length, error)."""
    return found.where("error IS NOT NULL").select("path", "offset", "length", "error")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as an archive in the shared folder, and describes the records that read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = f"{shared_dir(spark)}/foliant/warc-{uuid.uuid4().hex}"
    write(pages, path, "page_id", "html", "url")
    found = read(spark, path)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    whole = F.col("warc_type") == "response"
    found = found.select(
        "error",
        number("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.when(~whole, number("refers_to")).alias("refers_to"),
    )
    with batches(spark, 1):  # one file at a time, whatever its size
        found, _ = cut(found, "warc-records")
    drop(spark, path)
    counts = found.agg(F.count("*").alias("n"), F.count("error").alias("gaps")).first()
    if counts["gaps"] or counts["n"] != pages.count():
        raise RuntimeError(f"the archive has {counts['n']} records and {counts['gaps']} gaps")
    return found.drop("error")


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
     g AS (SELECT h, max(page_id) AS top, count(*) AS copies FROM d WHERE n >= {LEAST} GROUP BY h),
     j AS (SELECT d.*, top, copies > 1 AND page_id IS DISTINCT FROM top AS again FROM d LEFT JOIN g USING (h))
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to FROM j"""
