"""WARC derivatives: a metadata and a plain-text conversion record for every response record.

A response's block is taken apart into its HTTP status line, headers and payload (chunked and compressed
bodies are decoded). The metadata record lists the source record's identifier, headers and digests, the page's
title and its outlinks; the conversion record holds the rendered text of HTML pages, or the text itself of other
text types. Both refer to the response (``WARC-Refers-To``), keep its target URI and date, and carry digests of
their own. Identifiers are name-based on the source's identifier, so a rerun or retry writes the same records.

Records are UTF-8 text, so Spark's text writer with the record terminator as line separator writes valid
WARC files into any file system (``write_records``); ``read_records`` takes WARC files apart by content length.

Defined cases: null html is an empty payload and gives an empty conversion; a null url leaves out the target URI;
control characters in header values are percent-encoded; a response that is not HTTP or not text gets its metadata
record only; repeated rows give equal records; other columns are ignored; an empty table gives no records.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import map_arrow
from cohortlab.llm.html_text import Node, elements, parsed, text_of, title_of

VERSION, END = "WARC/1.1", "\r\n\r\n"
#: Date of records that are made from a table without dates.
DATE = "2025-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the namespace of URLs
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "form": "action"}
KIND = "record_id string, type string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, header string, block string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, '|'.join(parts))}>"


def _safe(value: str) -> str:
    return value if value.isprintable() else re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def header_text(fields: list[tuple[str, str | None]]) -> str:
    return VERSION + "\r\n" + "".join(f"{k}: {_safe(v)}\r\n" for k, v in fields if v is not None)


def response_record(page_id: str, url: str | None, html: str | None) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", identifier("response", page_id, url or "", digest(payload))), ("WARC-Date", DATE),
              ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)),
              ("WARC-Block-Digest", digest(http)), ("Content-Length", str(len(http)))]
    return header_text(fields).encode() + b"\r\n" + http


def responses(pages: DataFrame) -> DataFrame:
    """page_id, record: a response record (bytes) of every page (page_id, url, html)."""

    def run(batch: pa.RecordBatch):
        for i in range(0, batch.num_rows, 256):
            some = batch.slice(i, 256)
            made = [response_record(str(p), u, h) for p, u, h in zip(*(some.column(c).to_pylist() for c in range(3)))]
            yield pa.record_batch([some.column(0), pa.array(made, type=pa.binary())], ["page_id", "record"])

    kind = dict(pages.dtypes)["page_id"]
    return map_arrow(pages.select("page_id", "url", "html"), run, f"page_id {kind}, record binary")


def split_head(data: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(first line, headers, rest) of a WARC record or HTTP message."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], rest


def field(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def decoded(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without transfer and content encoding; what can't be decoded stays as it is."""
    if "chunked" in (field(headers, "Transfer-Encoding") or "").lower():
        out, rest = [], body
        while m := re.match(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n", rest):
            size = int(m[1], 16)
            out.append(rest[m.end() : m.end() + size])
            rest = rest[m.end() + size + 2 :]
            if not size:
                break
        body = b"".join(out) if out else body
    try:
        match (field(headers, "Content-Encoding") or "").lower():
            case "gzip" | "x-gzip":
                return gzip.decompress(body)
            case "deflate":
                try:
                    return zlib.decompress(body)
                except zlib.error:
                    return zlib.decompress(body, -zlib.MAX_WBITS)
    except (OSError, EOFError, zlib.error):
        pass
    return body


def text_body(content_type: str, body: bytes) -> str:
    m = re.search(r"charset=[\"']?([\w.:-]+)", content_type, re.I) or re.search(rb"<meta[^>]{0,200}?charset=[\"']?([\w.:-]+)", body[:2048], re.I)
    name = m[1] if m else "utf-8"
    try:
        return body.decode(name if isinstance(name, str) else name.decode("ascii", "replace"), "replace")
    except (LookupError, UnicodeDecodeError):
        return body.decode("utf-8", "replace")


def _outlinks(root: Node, uri: str) -> list[tuple[str, str]]:
    """(absolute address, element/@attribute) in document order."""
    base, host, out = uri, "", []
    for x in elements(root):
        name = LINKS.get(x.tag)
        if x.tag == "base" and x.attrs.get("href"):
            base, host = x.attrs["href"], ""
        elif name and (target := x.attrs.get(name)):
            try:
                host = host or urljoin(base, "/")[:-1] if base else ""
                plain = host and target[0] == "/" and target[:2] != "//" and "/." not in target
                out.append((host + target if plain else urljoin(base, target), f"{x.tag}/@{name}"))
            except ValueError:
                out.append((target, f"{x.tag}/@{name}"))
    return out


def derivatives(record: bytes) -> list[dict]:
    """The metadata and conversion records of one response record; none for other records."""
    _, source, block = split_head(record)
    if field(source, "WARC-Type") != "response":
        return []
    block = block[: int(field(source, "Content-Length") or len(block))]
    source_id, uri, date = field(source, "WARC-Record-ID") or "", field(source, "WARC-Target-URI"), field(source, "WARC-Date")
    status, http, body = split_head(block) if block.startswith(b"HTTP/") else ("", [], block)
    kind = field(http, "Content-Type") or ""
    is_html, is_text = "html" in kind.lower(), kind.lower().startswith("text/") or "html" in kind.lower()
    text, title, links = None, "", []
    if status and is_text:
        text = text_body(kind, decoded(http, body))
        if is_html:
            page = parsed(text)
            title, text = title_of(page.root), text_of(page)
            links = _outlinks(page.root, uri or "")
    payload_digest = field(source, "WARC-Payload-Digest") or digest(body)
    facts = [("source-record-id", source_id), *[("source-header", f"{k}: {v}") for k, v in source], ("source-payload-digest", payload_digest)]
    facts += [("http-status", status)] * bool(status) + [("http-header", f"{k}: {v}") for k, v in http] + [("title", title)] * bool(title)
    facts += [("outlink", f"{target} {how}") for target, how in links]
    made = [("metadata", "application/warc-fields", "".join(f"{k}: {_safe(v)}\r\n" for k, v in facts))]
    if text is not None:
        made.append(("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace").decode()))
    out = []
    for kind, content_type, content in made:
        data = content.encode()
        own, sha = identifier(kind, source_id), digest(data)
        fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source_id),
                  ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Payload-Digest", payload_digest if kind == "metadata" else sha),
                  ("WARC-Block-Digest", sha), ("Content-Type", content_type), ("Content-Length", str(len(data)))]
        out.append({"record_id": own, "type": kind, "refers_to": source_id, "target_uri": uri, "date": date, "content_type": content_type, "block_digest": sha,
                    "payload_digest": payload_digest, "header": header_text(fields), "block": content})
    return out


_NAMES = [x.split()[0] for x in KIND.split(", ")]


def _derived(keys: list, records, kind: pa.DataType, keep: str) -> pa.RecordBatch:
    made = [(k, d) for k, r in zip(keys, records) if r is not None for d in derivatives(r)]
    return pa.record_batch([pa.array([k for k, _ in made], type=kind), *[pa.array([d[n] for _, d in made], type=pa.string()) for n in _NAMES]], [keep, *_NAMES])


def derive(records: DataFrame, keep: str) -> DataFrame:
    """``keep`` (a column), and the derivatives of each response in column ``record`` (bytes).

    record_id, type, refers_to, target_uri, date, content_type, block_digest, payload_digest (of the source), header, block.
    """

    def run(batch: pa.RecordBatch):
        for i in range(0, batch.num_rows, 256):
            some = batch.slice(i, 256)
            yield _derived(some.column(0).to_pylist(), some.column(1).to_pylist(), some.schema.field(0).type, keep)

    return map_arrow(records.select(keep, "record"), run, f"{keep} {dict(records.dtypes)[keep]}, {KIND}")


def derive_pages(pages: DataFrame) -> DataFrame:
    """``derive(responses(pages), "page_id")`` in one step: the response records never leave the task."""

    def run(batch: pa.RecordBatch):
        for i in range(0, batch.num_rows, 256):
            some = batch.slice(i, 256)
            rows = list(zip(*(some.column(c).to_pylist() for c in range(3))))
            yield _derived([r[0] for r in rows], (response_record(str(p), u, h) for p, u, h in rows), some.schema.field(0).type, "page_id")

    return map_arrow(pages.select("page_id", "url", "html"), run, f"page_id {dict(pages.dtypes)['page_id']}, {KIND}")


def write_records(derived: DataFrame, path: str, **options: str) -> None:
    """WARC files of the derived records; option ``compression="gzip"`` packs them."""
    derived.select(F.concat("header", F.lit("\r\n"), "block").alias("value")).write.options(lineSep=END, **options).text(path)


def split_records(data: bytes) -> list[bytes]:
    """The records of a WARC file, without their terminators."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out, at = [], 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            break
        m = re.search(rb"\r\nContent-Length:\s*(\d+)", data[at : stop + 2], re.I)
        end = stop + 4 + int(m[1] if m else 0)
        out.append(data[at:end])
        at = end
        while data[at : at + 2] == b"\r\n":
            at += 2
    return out


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, record (bytes) of all WARC files below the path; a file is read by one task."""

    def run(batch: pa.RecordBatch):
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = split_records(content.as_py())
            for i in range(0, len(found), 256):
                some = found[i : i + 256]
                yield pa.record_batch([pa.array([name] * len(some), type=pa.string()), pa.array(some, type=pa.binary())], ["file", "record"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return map_arrow(files, run, "file string, record binary")
