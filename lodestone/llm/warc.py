"""WARC archives: a writer that dedupes payloads, and a sequential reader.

An archive is a run of gzip members, one for each record. The reader inflates a member
step by step, frames the record by its Content-Length, takes up at the next member and
recomputes the digest of every payload. Of records with equal payloads, the one with the
largest page_id is a response; the others are revisits that name it.

Defined results: a null payload is an empty one; rows that share the largest page_id
of a payload are all responses; a null page_id counts as smaller than any other; an empty table
gives an empty archive folder and no rows; bad framing or a wrong digest raises.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import session, shared_path, text_bytes

#: An archive is closed when its compressed size passes this.
ARCHIVE_BYTES = 32 << 20
#: Compressed bytes that the reader hands to zlib at once, and inflated bytes it takes at once.
STEP = 1 << 16
#: A gzip member without content; Spark's text writer ends each row with it, so the files are whole gzip streams.
_EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
_DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(number: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has no payload; its headers tell the full one's size and digest."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if refers_to is None else b"")
    target = "".join(c for c in url or "" if c >= " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if number is None else number}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03" + deflate.compress(raw) + deflate.flush() + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class BadArchive(ValueError):
    """The bytes aren't a WARC archive as written."""


class _Member:
    """The inflated bytes of one gzip member, as a stream."""

    def __init__(self, data: memoryview, at: int) -> None:
        self.data, self.at, self.held = data, at, bytearray()
        self.inflater = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.inflater.eof:
            return False
        left = self.inflater.unconsumed_tail
        if not left:
            if self.at >= len(self.data):
                raise BadArchive("a member is cut off")
            left = self.data[self.at : self.at + STEP]
            self.at += len(left)
        try:
            self.held += self.inflater.decompress(left, STEP)
        except zlib.error as error:
            raise BadArchive(str(error)) from error
        return True

    def line(self) -> bytes | None:
        start = 0
        while (end := self.held.find(b"\r\n", start)) < 0:
            start = max(0, len(self.held) - 1)
            if not self._more():
                if self.held:
                    raise BadArchive("a header is cut off")
                return None
        found = bytes(self.held[:end])
        del self.held[: end + 2]
        return found

    def exactly(self, n: int) -> bytes:
        parts = []
        while n:
            if not self.held and not self._more():
                raise BadArchive("a block is shorter than its Content-Length")
            took = self.held[:n]
            parts.append(bytes(took))
            del self.held[: len(took)]
            n -= len(took)
        return b"".join(parts)

    def finish(self) -> int:
        """Where the next member starts."""
        while not self.inflater.eof:
            self._more()
        if self.held:
            raise BadArchive("a member holds more than one record")
        return self.at - len(self.inflater.unused_data)


def read(data: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of an archive, one after another."""
    view, at = memoryview(data), 0
    while at < len(view):
        member = _Member(view, at)
        version = member.line()
        if version is None:
            at = member.finish()
            continue
        if not version.startswith(b"WARC/"):
            raise BadArchive("a record doesn't begin with its version")
        headers: dict[str, str] = {}
        while line := member.line():
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError) as error:
            raise BadArchive("a record has no Content-Length") from error
        block = member.exactly(length)
        if member.exactly(4) != b"\r\n\r\n":
            raise BadArchive("a record doesn't end where its Content-Length says")
        at = member.finish()
        if headers.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
            raise BadArchive("a block's digest is wrong")
        yield headers, block


def payload_of(headers: dict[str, str], block: bytes) -> bytes | None:
    """The checked payload of a response; None for a revisit."""
    if headers["warc-type"] == "revisit":
        return None
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["warc-payload-digest"] != f"sha1:{digest(payload)}":
        raise BadArchive("a payload's digest is wrong")
    return payload


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    for batch in batches:
        number, url, payload, refers = batch.columns
        for i in range(batch.num_rows):
            parts.append(record(number[i].as_py(), url[i].as_py(), payload[i].as_py() or b"", refers[i].as_py()))
            size += len(parts[-1])
            if size >= ARCHIVE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["archive"])
                parts, size = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["archive"])


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write a record for each row to archives under ``path``."""
    session(pages.sparkSession)
    data = F.coalesce(text_bytes(payload_col), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), data.alias("payload"), F.sha1(data).alias("sha"))
    # Largest ids are combined before the shuffle, and the join is one that Spark can split.
    last = rows.groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("c")).where("c > 1").select("sha", "last")
    marked = rows.join(last, "sha", "left").select("id", "url", "payload", F.when(F.coalesce(F.col("id") < F.col("last"), F.col("id").isNull()), F.col("last")).alias("refers"))
    archives = marked.mapInArrow(_write, "archive binary")
    # The text writer puts out a string's bytes as they are, and ends each with the empty member.
    archives.select(F.col("archive").cast("string")).write.option("lineSep", _EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


_ROW = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _number(text: str) -> int | None:
    digits = text.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _read(batches, payloads)

    return run


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _ROW.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for headers, block in read(content.as_buffer()):
                payload = payload_of(headers, block)
                length = int(headers["x-payload-length"])
                if payload is not None and len(payload) != length:
                    raise BadArchive("a payload's length is wrong")
                refers = headers.get("warc-refers-to")
                rows.append((_number(headers["warc-record-id"]), headers["warc-target-uri"], payload if payloads else None, length, headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"], refers and _number(refers)))
                size += len(block) * payloads
                if size >= ARCHIVE_BYTES:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path``; each archive is read by one task, from its beginning.

    Every payload is inflated and checked; with ``payloads`` false it isn't passed on.
    """
    # An archive fills an Arrow batch by its bytes, so a worker has one at a time.
    session(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_reader(payloads), _ROW)


def op5_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
d AS (SELECT page_id, n, last, list_transform(generate_series(0, 7), lambda k: CAST('0x' || substr(h, 5 * k + 1, 5) AS INTEGER)) AS g FROM p JOIN w USING (h))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(g, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> b) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM d
"""
