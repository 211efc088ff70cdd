"""WARC archives with revisit records, and a reader that salvages damaged files.

Writing: rows with equal payloads (by SHA-256) are grouped before the payloads move; the one
with the smallest page id becomes a ``response``, the others ``revisit`` records that refer to
it and carry no payload. A task packs its records into archives of about ``FILE_BYTES``, each
record a gzip member of its own, or plain. Spark's text writer puts them on the shared store:
an archive is one value, and its last byte is the line separator (0 for gzip, whose members end
in a zero byte unless they hold 16 MB or more; an empty member follows those).

Reading: each archive is walked from record to record, gzip members and plain records alike.
Every record must pass its checks: gzip checksum and length, version line, header lines, content
length, closing blank lines, block and payload digests. After a failed check the reader looks for
the next place where a member begins a version line, or a version line stands, and goes on
there; the bytes in between become a row of kind ``gap`` with their place and the first
reason. Neighbouring gaps are one. Nothing else is lost: records behind the damage come back.

Defined results: null and empty payloads are payloads of no bytes and equal to each other. Rows
that repeat a page id and a payload are alike: all response or all revisit. A null id never wins
over another; in a group of null ids only all are responses. Payloads shorter than
``min_bytes`` are responses always. Null urls leave the header out; blanks and control characters in
urls are percent-encoded. An empty table gives no archives and no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheetweave.llm.store import Store
from sheetweave.llm.texts import map_rows

#: Bytes after which a task begins a new archive.
FILE_BYTES = 16 << 20
#: Compressed bytes that are inflated at a time, and the level of compression.
CHUNK, LEVEL = 1 << 14, 5
#: Date of all records: archives of the same rows are the same bytes.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = ("kind string, file string, offset long, length long, reason string, record_type string, page_id long, "
          "url string, payload_bytes long, payload_digest string, refers_to long, payload binary")

_END = b"\r\n\r\n"
_VERSIONS = (b"WARC/1.0", b"WARC/1.1")
#: Where a record may begin: a gzip header or a version line, also if the line end before it is damaged.
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_SPACES = {c: f"%{c:02X}" for c in (*range(33), 127)}


class Damaged(Exception):
    """A failed check, with its reason."""


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes

    def payload(self) -> bytes:
        """The block without HTTP headers."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(_END)[2]
        return self.block


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


def sha1(data: bytes) -> str:
    """Base32 SHA-1, in upper case."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def form(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A plain record."""
    headers = [*headers, ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers)
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + block + _END


def member(record: bytes) -> bytes:
    """A record as gzip member whose last byte is zero."""
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    data = press.compress(record) + press.flush()
    return data if not data[-1] else data + member(b"")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of the record of page ``refers_to``."""
    digest = sha1(payload)
    target = [] if url is None else [("WARC-Target-URI", quote(url.translate(_SPACES), safe="".join(map(chr, range(33, 127)))))]
    page = [] if page_id is None else [("X-Page-Id", str(page_id))]
    headers = [("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), *target, *page,
               ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return form([("WARC-Type", "response"), *headers], block + payload)
    return form([("WARC-Type", "revisit"), *headers, ("WARC-Profile", PROFILE),
                 ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))], block)


def info_record() -> bytes:
    return form([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, "info")), ("WARC-Date", DATE),
                 ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, compress: bool = True,
               file_bytes: int = FILE_BYTES) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html) in archives below ``path``."""
    store = Store(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    key = F.unhex(F.sha2("payload", 256)).alias("digest")
    shared = store.save(rows.where(F.octet_length("payload") >= min_bytes).select("page_id", key)
                        .groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                        .where("n > 1").select("digest", "first"))
    told = store.attach(rows.withColumn("digest", key), shared, "digest", "left").select(
        "page_id", "url", "payload",
        F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))

    def work(told) -> Iterator[tuple]:
        seal = member if compress else bytes
        held, size = [], 0
        for row in told:
            if not held:
                held, size = [seal(info_record())], 0
            held.append(seal(page_record(*row)))
            size += len(held[-1])
            if size >= file_bytes:
                yield (b"".join(held)[:-len(end)],)
                held = []
        if held:
            yield (b"".join(held)[:-len(end)],)

    end = "\0" if compress else "\r\n\r\n"
    (map_rows(told, work, "data binary").select(F.col("data").cast("string").alias("value"))
     .write.option("lineSep", end).option("maxRecordsPerFile", 1).text(path))


def inflate(data: memoryview, at: int, limit: int | None = None) -> tuple[bytes, int]:
    """The content of the gzip member at ``at`` and the place behind it; with ``limit`` only the
    first bytes of it."""
    engine, parts, place = zlib.decompressobj(31), [], at
    try:
        while not engine.eof and place < len(data):
            piece = data[place:place + CHUNK]
            parts.append(engine.decompress(piece, limit or 0))
            place += len(piece)
            if limit:
                break
    except zlib.error as error:
        raise Damaged(f"gzip member: {error}") from None
    if not limit and not engine.eof:
        raise Damaged("gzip member is cut short")
    return b"".join(parts), place - len(engine.unused_data)


def headers_of(head: bytes) -> dict[str, str]:
    version, *lines = head.split(b"\r\n")
    if version not in _VERSIONS:
        raise Damaged("no version line")
    found: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:  # a folded line goes on
            found[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        name = key.strip().lower().decode("utf-8", "replace")
        found[name] = value.strip().decode("utf-8", "replace")
    return found


def checked(data: bytes, at: int, end: int | None) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the plain record at ``at`` and the place behind it, which must be
    ``end`` if that is given."""
    stop = data.find(_END, at)
    if stop < 0:
        raise Damaged("headers do not end")
    headers = headers_of(data[at:stop])
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise Damaged("no content length")
    start, behind = stop + 4, stop + 4 + int(size)
    if data[behind:behind + 4] != _END or (end is not None and behind + 4 != end):
        raise Damaged("block has another length")
    block = data[start:behind]
    record = Record(0, 0, headers, block)
    for name, content in (("warc-block-digest", block), ("warc-payload-digest", None)):
        kind, _, digest = headers.get(name, "").partition(":")
        if kind != "sha1" or (content is None and headers.get("warc-type") == "revisit"):
            continue  # the payload of a revisit is elsewhere
        if sha1(record.payload() if content is None else content) != digest.upper():
            raise Damaged(f"{name} differs")
    return headers, block, behind + 4


def next_start(data: bytes, view: memoryview, at: int) -> int:
    """The next place from ``at`` on where a record may begin, or the end."""
    for found in _START.finditer(data, at):
        if found[0][:1] == b"W":
            return found.start()
        try:
            if inflate(view, found.start(), 7)[0] == b"WARC/1.":
                return found.start()
        except Damaged:
            pass
    return len(data)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records of an archive that pass their checks, and the gaps between them."""
    at, gap, view = 0, None, memoryview(data)
    while at < len(data):
        try:
            if data[at:at + 2] == b"\x1f\x8b":
                content, behind = inflate(view, at)
                headers, block, _ = checked(content, 0, len(content)) if content else (None, b"", 0)
            else:
                headers, block, behind = checked(data, at, None)
        except Damaged as reason:
            gap = gap or (at, str(reason))
            at = next_start(data, view, at + 1)
            continue
        if gap:
            yield Gap(gap[0], at - gap[0], gap[1])
            gap = None
        if headers is not None:  # an empty member holds nothing
            yield Record(at, behind - at, headers, block)
        at = behind
    if gap:
        yield Gap(gap[0], at - gap[0], gap[1])


def number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch("-?[0-9]{1,19}", text) else None


def record_row(file: str, record: Record, payloads: bool) -> tuple:
    headers, payload = record.headers, record.payload()
    kind, size = headers.get("warc-type"), len(payload)
    if kind == "revisit":  # the HTTP headers tell the size of what is elsewhere
        told = re.search(rb"(?i)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", record.block, re.M)
        size = int(told[1]) if told else None
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or (sha1(payload) if size is not None else None)
    return ("record", file, record.offset, record.length, None, kind, number(headers.get("x-page-id")),
            headers.get("warc-target-uri"), size, digest, number(headers.get("x-refers-to-page-id")),
            payload if payloads and kind != "revisit" else None)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each response, revisit and gap (``kind``) of the archives below ``path``, with
    the file, and the offset and length of its bytes there."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", "content"))

    def work(rows):
        for file, content in rows:
            for found in salvage(content):
                if isinstance(found, Gap):
                    yield "gap", file, found.offset, found.length, found.reason, *[None] * 7
                elif found.headers.get("warc-type") in ("response", "revisit"):
                    yield record_row(file, found, payloads)

    return map_rows(files, work, SCHEMA)


def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = Store(spark).base + "-warc"
    write_warc(spark.read.parquet(f"{folder}/pages.parquet"), path)
    return read_warc(spark, path, payloads=False).where("kind = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
g AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex,
             min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(hex, 5 * i + 1, 5))::INTEGER >> (15 - 5 * j)) & 31)::INTEGER, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM g
"""
