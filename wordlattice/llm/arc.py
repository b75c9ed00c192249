"""ARC to WARC conversion.

An ARC file is a version block and records. The version block's first line is
itself a record header; its second line names the version. Version 1 headers
hold URL, IP address, archive date, content type and length; version 2 headers
hold URL, IP address, archive date, content type, result code, checksum,
location, offset, file name and length. The length counts the bytes that follow
the header's line break, and a line break ends the record.

The converter reads headers by the version in force and payloads by their
declared length, and makes WARC/1.0 records of them:

* WARC-Record-ID is a version-8 UUID that holds the page's id (64 bits) and bits
  of the payload's digest, so equal input gives equal ids;
* WARC-Date is the archive date in ISO 8601; WARC-Payload-Digest is the SHA-1 of
  the HTTP body, in base32;
* of records with equal bodies the one with the smallest page id is a response;
  the others are revisits that refer to it and keep only their HTTP header.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordlattice.llm.common import look_up, shared_dir, stored

#: Archive date of pages, which carry none.
DATE = "20000101000000"
#: Records in a WARC file, at most, so that a reader's memory is bounded.
FILE_RECORDS = 10_000
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Text that a synthesised ARC file gathers before it is converted, about.
ARC_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

_V1 = ("url", "ip", "date", "type", "length")
_V2 = ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "file", "length")


@dataclass
class ArcRecord:
    """One record: its header's fields and the bytes of its declared length."""

    fields: dict[str, str]
    block: bytes


def digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- ARC ---------------------------------------------------------------------


def _url(url: str | None) -> str:
    """A URL for a header line, where blanks and control characters can't stand; '-' for none."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "") or "-"


def arc_file(version: int, records) -> bytes:
    """An ARC file of records (url, date, content type, block)."""
    names = "URL IP-address Archive-date Content-type " + ("Archive-length" if version == 1 else "Result-code Checksum Location Offset Filename Archive-length")
    info = f"{version} 0 wordlattice\n{names}\n".encode()
    head = f"filedesc://pages.arc 0.0.0.0 {DATE} text/plain " + ("" if version == 1 else "200 - - 0 pages.arc ")
    out, size = [f"{head}{len(info)}\n".encode(), info, b"\n"], 0
    for url, date, kind, block in records:
        size = sum(map(len, out[-3:])) + size
        middle = "" if version == 1 else f"200 - - {size} pages.arc "
        out += [f"{_url(url)} 0.0.0.0 {date} {kind} {middle}{len(block)}\n".encode(), block, b"\n"]
    return b"".join(out)


def read_arc(data: bytes):
    """Yields the records of an ARC file, its version block left out.

    Raises ValueError on a header that doesn't fit the version, or a length
    beyond the end of the file.
    """
    place, names = 0, None
    while place < len(data):
        stop = data.find(b"\n", place)
        if stop < 0:
            raise ValueError(f"header at {place} doesn't end")
        line = data[place:stop].decode("utf-8", "replace").rstrip("\r")
        if not line:  # line breaks between records
            place = stop + 1
            continue
        parts = line.split(" ")
        if names is None:
            if not line.startswith("filedesc:"):
                raise ValueError("not an ARC file")
            size = int(parts[-1])
            version = data[stop + 1 : stop + 1 + size].split(b" ", 1)[0]
            if version not in (b"1", b"2"):
                raise ValueError(f"unknown ARC version {version!r}")
            names = _V1 if version == b"1" else _V2
            place = stop + 1 + size
            continue
        # a URL may hold blanks in old files: the other fields count from the right
        rest = len(names) - 1
        if len(parts) <= rest or not parts[-1].isdigit():
            raise ValueError(f"bad header at {place}: {line[:80]!r}")
        fields = dict(zip(names, [" ".join(parts[:-rest]), *parts[-rest:]], strict=True))
        place = stop + 1 + int(fields["length"])
        if place > len(data):
            raise ValueError(f"record at {stop + 1} ends beyond the file")
        yield ArcRecord(fields, data[stop + 1 : place])


# -- WARC --------------------------------------------------------------------


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and body; a block without a header is all body."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    stop = block.find(b"\r\n\r\n")
    return (block, b"") if stop < 0 else (block[: stop + 4], block[stop + 4 :])


def _field(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n"):
        if line[: len(name) + 1].lower() == name.lower() + b":":
            return line[len(name) + 1 :].strip().decode()
    return None


def record_id(page_id: int | None, seed: bytes) -> str:
    """A version-8 UUID of a page's id (64 bits), 40 bits of a seed's digest, and whether there is an id."""
    page = (page_id or 0) & (1 << 64) - 1
    extra = int.from_bytes(hashlib.sha1(seed).digest()[:5], "big")
    return str(uuid.UUID(int=(page >> 16) << 80 | 8 << 76 | 2 << 62 | (page & 0xFFFF) << 46 | extra << 6 | (page_id is None)))


def page_of(rid: str) -> int | None:
    """The page's id that record_id() put into a UUID."""
    n = uuid.UUID(rid.strip("<>").removeprefix("urn:uuid:")).int
    if n & 1:
        return None
    page = (n >> 80) << 16 | (n >> 46) & 0xFFFF
    return page - (1 << 64) if page >> 63 else page


def to_warc(record: ArcRecord, response: int | None = None) -> bytes:
    """A WARC record without its closing line breaks; a revisit if ``response``, another page's id, is given."""
    head, payload = split_http(record.block)
    url, date = record.fields["url"], record.fields["date"]
    page = _field(head, b"X-Page-Id")
    page_id = int(page) if page else None
    sha = digest(payload)
    made = lambda p: f"<urn:uuid:{record_id(p, sha.encode())}>"
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z" if len(date) == 14 and date.isdigit() else "1970-01-01T00:00:00Z"
    block = record.block if response is None else head
    lines = ["WARC/1.0", f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: {made(page_id)}", f"WARC-Date: {stamp}", f"WARC-Target-URI: {url}", f"WARC-IP-Address: {record.fields['ip']}", f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if response is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {made(response)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def read_warc(chunks):
    """Yields (header fields, block) from an iterator of byte chunks of a WARC file."""
    data, chunks = bytearray(), iter(chunks)

    def more() -> bool:
        chunk = next(chunks, None)
        if chunk is None:
            return False
        data.extend(chunk)
        return True

    while True:
        while data[:2] == b"\r\n" or len(data) < 4:
            if data[:2] == b"\r\n":
                del data[:2]
            elif not more():
                if data.strip():
                    raise ValueError("the file ends within a record")
                return
        while (stop := data.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a header doesn't end")
        lines = bytes(data[:stop]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = stop + 4 + int(fields["content-length"])
        while len(data) < size:
            if not more():
                raise ValueError("the file ends within a record")
        block = bytes(data[stop + 4 : size])
        del data[:size]
        yield fields, block


def _inflated(content):
    """Chunks of a gzip file's data, one after the other; several members are fine."""
    view, place, size = memoryview(content), 0, 1 << 18
    while place < len(view):
        unpack = zlib.decompressobj(31)
        while place < len(view) and not unpack.eof:
            chunk = view[place : place + size]
            place += len(chunk)
            yield unpack.decompress(chunk)
        place -= len(unpack.unused_data)


# -- Spark -------------------------------------------------------------------


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Archives pages as ARC files, converts them, and writes gzipped WARC files under ``path``.

    A null html is an empty payload, a null URL '-'. Repeated rows each get a
    record; those with the smallest id of their payload are responses. Rows
    without an id are responses unless a row with an id has the same payload.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    small = F.octet_length("html") < least_bytes
    # count and smallest id of each payload; only payloads that repeat are looked up
    found = rows.where(~small).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("_n")).where("_n > 1")
    rows = look_up(rows, stored(found), "sha", pages.count())

    def run(batches):
        version = 1

        def convert(held):
            nonlocal version
            version = 3 - version  # either version takes its turn
            arc = arc_file(version, [(url, DATE, "text/html", http(page, html)) for page, url, html, _ in held])
            out = [to_warc(r, first if first is not None and first != page else None) for r, (page, _, _, first) in zip(read_arc(arc), held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

        held, size = [], 0
        for batch in batches:
            for page, url, html, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append((page, url, html.encode(), first))
                size += len(held[-1][2])
                if size > ARC_BYTES:
                    yield convert(held)
                    held, size = [], 0
        if held:
            yield convert(held)

    out = rows.select("page_id", "url", "html", "first").mapInArrow(run, "record binary")
    out.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def http(page_id: int | None, payload: bytes) -> bytes:
    """An HTTP response that carries a page's id."""
    page = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of the records under ``path``.

    A revisit has no payload of its own; its size and digest are those of the
    payload it stands for. Digests of responses are checked against their data.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                out = []
                for fields, block in read_warc(_inflated(content.as_buffer())):
                    head, payload = split_http(block)
                    sha, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                    if kind == "response" and digest(payload) != sha:
                        raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
                    to = fields.get("warc-refers-to")
                    out.append((page_of(fields["warc-record-id"]), int(_field(head, b"Content-Length") or len(payload)), sha, kind, page_of(to) if to else None, fields["warc-target-uri"], payload if kind == "response" else None))
                    if len(out) >= 500:
                        yield _batch(out)
                        out = []
                yield _batch(out)

    def _batch(rows):
        kinds = pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the archives and reads them back; see write() and read()."""
    path = path or shared_dir(pages.sparkSession)
    write(pages, path, **options)
    return read(pages.sparkSession, path)
