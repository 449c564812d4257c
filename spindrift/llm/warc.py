"""WARC derivatives: metadata and plain-text conversion records of response records.

A response gives two records that refer to it: ``metadata`` (warc-fields with the HTTP status, the
source's HTTP headers and digests) and ``conversion`` (the page's text).  Both keep the target URI
and date of the response and name it in WARC-Refers-To; record ids are drawn from contents, so a
rerun writes the same ones.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require

VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
Headers = list[tuple[str, str]]

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.IGNORECASE | re.DOTALL)
_BREAK = re.compile(r"""</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|td|th|tr|ul)\b(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?:>|\Z)|[^>]*(?:>|\Z))""", re.IGNORECASE)
_TAG = re.compile(r"""</?[a-zA-Z!?](?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?:>|\Z)|[^>]*(?:>|\Z))""")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.IGNORECASE)


def digest(data: bytes) -> str:
    """``sha1:`` and the Base32 form that archives use."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str | bytes) -> str:
    """A urn:uuid drawn from the parts."""
    h = hashlib.sha256()
    for p in parts:
        raw = p.encode("utf-8", "surrogatepass") if isinstance(p, str) else p
        h.update(len(raw).to_bytes(8, "big") + raw)
    return f"<urn:uuid:{uuid.UUID(bytes=h.digest()[:16], version=4)}>"


def value(headers: Headers, name: str, default: str = "") -> str:
    """The first header of that name, letter case ignored."""
    return next((v for k, v in headers if k.lower() == name.lower()), default)


def write_record(headers: Headers, block: bytes) -> bytes:
    """One record; Content-Length is set from the block, line breaks in values become spaces."""
    lines = [VERSION, *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers if k.lower() != "content-length"), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _header_lines(raw: bytes) -> Headers:
    out: Headers = []
    for line in raw.decode("utf-8", "replace").split("\r\n" if b"\r\n" in raw else "\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def inflate(data: bytes, faults: list[str] | None = None) -> bytes:
    """Gzipped data, member by member; what is cut off or damaged ends it and is noted in ``faults``."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(wbits=31)
        try:
            out.append(member.decompress(data))
        except zlib.error as fault:
            if faults is not None:
                faults.append(f"gzip: {fault}")
            break
        if not member.eof:
            if faults is not None:
                faults.append("gzip: cut off")
            break
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out)


_START = re.compile(rb"(?:\A|(?<=\n))WARC/\d")


def read_records(data: bytes, faults: list[str] | None = None) -> Iterator[tuple[Headers, bytes]]:
    """(headers, block) of each record; data may be plain or gzipped, record by record or whole.

    Records are found by their Content-Length.  A record that is cut off or malformed is passed over
    and reading goes on at the next line that starts one; what was wrong is noted in ``faults``.
    """
    data = inflate(data, faults)
    at = 0
    while True:
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        headers = _header_lines(data[at:end].partition(b"\r\n")[2]) if end >= 0 and _START.match(data, at) else []
        length = value(headers, "Content-Length")
        if not (length.isascii() and length.isdigit()) or end + 4 + int(length) > len(data):
            if faults is not None:
                faults.append(f"no whole record at byte {at}")
            following = _START.search(data, at + 1)
            if following is None:
                return
            at = following.start()
            continue
        at = end + 4 + int(length)
        yield headers, data[end + 4 : at]


def response_record(url: str, body: bytes, date: str = DATE, status: str = "200 OK", content_type: str = "text/html; charset=utf-8") -> tuple[Headers, bytes]:
    """A response record around a page's body."""
    head = f"HTTP/1.1 {status}\r\nContent-Type: {content_type}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block, payload = head + body, digest(body)
    return [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", url, date, payload)),
        ("WARC-Target-URI", url),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", payload),
        ("WARC-Block-Digest", digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
    ], block


def split_http(block: bytes) -> tuple[str, Headers, bytes]:
    """(status line, headers, body) of an HTTP response; without a head, all is body."""
    for mark in (b"\r\n\r\n", b"\n\n"):
        head, found, body = block.partition(mark)
        if found and head.startswith(b"HTTP/"):
            first, _, rest = head.partition(b"\r\n" if mark[:1] == b"\r" else b"\n")
            return first.decode("utf-8", "replace"), _header_lines(rest), body
    return "", [], block


def plain_text(html: str) -> str:
    """All visible text: blocks on lines of their own, white space within a line as one space."""
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", html).replace("\n", " ")))
    lines = (" ".join(line.split()) for line in unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def derive(headers: Headers, block: bytes) -> list[tuple[Headers, bytes]]:
    """The metadata and the conversion record of a response; of any other record, none."""
    if value(headers, "WARC-Type").lower() != "response":
        return []
    status, http, body = split_http(block)
    source = value(headers, "WARC-Record-ID")
    payload = value(headers, "WARC-Payload-Digest") or digest(body)
    named = _CHARSET.search(value(http, "Content-Type"))
    try:
        html = body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        html = body.decode("utf-8", "replace")
    fields = [("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in http), ("source-payload-digest", payload), ("source-block-digest", value(headers, "WARC-Block-Digest") or digest(block)), ("source-content-length", str(len(block)))]
    out = []
    for kind, content_type, content in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")),
        ("conversion", "text/plain; charset=utf-8", plain_text(html).encode("utf-8", "surrogatepass")),
    ):
        own = digest(content)
        out.append(([("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source, own)), ("WARC-Refers-To", source), ("WARC-Target-URI", value(headers, "WARC-Target-URI")), ("WARC-Date", value(headers, "WARC-Date")), ("WARC-Block-Digest", own), ("Content-Type", content_type)], content))
    return out


DERIVED = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, block_digest string, source_payload_digest string, content_length long, content string"


def _row(key, payload: str, headers: Headers, content: bytes) -> tuple:
    return (key, *(value(headers, n) for n in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type", "WARC-Block-Digest")), payload, len(content), content.decode("utf-8", "replace"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in DERIVED.split(", ")]
    kinds = {"page_id": pa.int64(), "content_length": pa.int64()}
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns)], names=names)


def derive_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """The derived records of each page (page_id, url, html), as one row each.

    A page is first written as a response record and read back.  Null html is an empty body, a null
    url an empty target; whole pages of any length are kept.  Repeated rows each give their records,
    with the same ids; an empty table gives none; extra columns are ignored.
    """
    require(pages, "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for key, url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw = write_record(*response_record(url or "", (html or "").encode("utf-8", "surrogatepass"), date))
                    for headers, block in read_records(raw):
                        payload = value(headers, "WARC-Payload-Digest")
                        rows += [_row(key, payload, h, c) for h, c in derive(headers, block)]
                yield _batch(rows)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, DERIVED)


def derive_files(files: DataFrame) -> DataFrame:
    """The derived records of WARC files, from rows with ``content`` as the binaryFile reader gives.

    page_id is the place of the record within its file.  What could not be read of a file, cut off
    or malformed, gives a row of type ``unreadable`` each, with the reason as content and no
    page_id.  Null and empty contents give no rows, repeated files repeated ones; extra columns are
    ignored.  A file is read whole, so files should stay within an executor's memory, as archives of
    about a gigabyte do.
    """
    require(files, "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                faults: list[str] = []
                for n, (headers, block) in enumerate(read_records(data.as_py() or b"", faults)):
                    payload = value(headers, "WARC-Payload-Digest")
                    rows += [_row(n, payload, h, c) for h, c in derive(headers, block)]
                    if len(rows) >= 1024:
                        yield _batch(rows)
                        rows = []
                rows += [_row(None, "", [("WARC-Type", "unreadable")], fault.encode()) for fault in faults]
                yield _batch(rows)

    return files.select("content").mapInArrow(run, DERIVED)
