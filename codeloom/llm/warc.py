"""Operator 4: WARC derivatives: linked metadata and plain-text conversion records from responses.

``parse_records`` reads WARC bytes (plain or gzip, one member or many), ``responses`` makes response
records of a table of pages, ``derivatives`` turns each response into a ``metadata`` record (JSON:
source headers, HTTP headers, title, links, digests) and a ``conversion`` record (plain text).
Both refer to the response's record id, keep its target, date and payload digest, and carry their own block digest;
record ids are name-based, so a task that runs again makes the same ones.  Everything is one pass without a shuffle.

Edge cases: null html is an empty payload, null url an empty target; a response whose HTTP head has no end is all payload;
broken markup never fails (an unclosed tag, comment or script runs to the end of the text); a record with a bad length ends at the next record, a broken gzip
member ends the file; equal pages give equal
texts, and equal rows equal records; empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

DATE = "1970-01-01T00:00:00Z"  # of responses made from tables, which have no date
NAMESPACE = uuid.UUID(int=0)
_BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
_HIDDEN = frozenset("script style noscript template".split())
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)")
_LINK = {"a": "href", "area": "href", "link": "href", "img": "src", "iframe": "src", "script": "src"}
_ATTRIBUTE = {n: re.compile(rf"""\s{n}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I) for n in set(_LINK.values())}
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" *\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _head(data: bytes) -> list[tuple[str, str]]:
    """Name and value of header lines; continuation lines belong to the value before."""
    out: list[tuple[str, str]] = []
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {line.strip()}"
        elif ":" in line:
            name, value = line.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def inflated(data: bytes) -> bytes:
    """The bytes of all gzip members one after another; a broken or cut member ends them."""
    out, rest = [], data
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(rest))
        except zlib.error:
            break
        rest = member.unused_data
    return b"".join(out)


def parse_records(data: bytes):
    """(headers, block) of each record of a WARC file's bytes.

    A length that is missing or no whole number is taken as everything up to the next record; a length beyond the end as the end.
    """
    if data[:2] == b"\x1f\x8b":
        data = inflated(data)
    at = data.find(b"WARC/")
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = _head(data[at:end])
        size = next((v for k, v in headers if k.lower() == "content-length"), "")
        begin = end + 4
        if size.isascii() and size.isdigit():
            stop = min(len(data), begin + int(size))
            yield headers, data[begin:stop]
            at = data.find(b"WARC/", stop)
        else:
            at = data.find(b"\r\n\r\nWARC/", end)
            yield headers, data[begin:at] if at >= begin else data[begin:] if at < 0 else b""
            at = at + 4 if at >= 0 else -1


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of a response's block."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return "", [], block
    head = block[:end]
    return head.split(b"\r\n", 1)[0].decode("utf-8", "replace"), _head(head), block[end + 4 :]


def _attribute(tag: str, name: str) -> str | None:
    found = _ATTRIBUTE[name].search(tag)
    return html.unescape(next(x for x in found.groups() if x is not None)) if found else None


def text_and_links(source: str) -> tuple[str, str, list[str]]:
    """Title, plain text and links (in order) of a page; one walk from tag to tag."""
    out, links, title, at, n = [], [], None, 0, len(source)
    lowered = source.lower() if source.isascii() else source.encode().lower().decode()
    while at < n:
        begin = source.find("<", at)
        if begin < 0:
            out.append(html.unescape(source[at:]))
            break
        out.append(html.unescape(source[at:begin]))
        if source.startswith("<!--", begin):
            end = source.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            continue
        tag = _TAG.match(source, begin)
        if not tag:
            if source[begin + 1 : begin + 2] in ("!", "?", "/"):
                end = source.find(">", begin)
                at = n if end < 0 else end + 1
            else:
                out.append("<")
                at = begin + 1
            continue
        end = source.find(">", tag.end())
        end = n if end < 0 else end + 1
        name, closing = tag[2].lower(), bool(tag[1])
        if name in _LINK and not closing:
            target = _attribute(source[begin:end], _LINK[name])
            if target:
                links.append(target)
        if name in _BREAKS:
            out.append("\n")
        at = end
        if name in _HIDDEN and not closing:
            close = lowered.find(f"</{name}", end)
            at = n if close < 0 else close
        elif name == "title" and not closing and title is None:
            close = lowered.find("</title", end)
            title = " ".join(html.unescape(source[end : n if close < 0 else close]).split())
    text = _LINES.sub("\n", _BLANKS.sub(" ", "".join(out).replace("\r", "\n"))).strip()
    return title or "", text, links


def derive(headers: list[tuple[str, str]], block: bytes) -> list[tuple[str, str, str, str, bytes, bytes]]:
    """(kind, record id, refers to, target, content, record) of the metadata and the conversion of a response."""
    named = {k.lower(): v for k, v in headers}
    source, target = named.get("warc-record-id", ""), named.get("warc-target-uri", "")
    status, http, payload = split_http(block)
    paid = named.get("warc-payload-digest") or digest(payload)
    title, text, links = text_and_links(payload.decode("utf-8", "replace"))
    envelope = {"warc": dict(headers), "http": {"status": status, "headers": [list(x) for x in http]}, "payload": {"digest": paid, "length": len(payload)}, "html": {"title": title, "links": links}}
    out = []
    for kind, type_, content in (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode()), ("conversion", "text/plain", text.encode("utf-8", "replace"))):
        name = record_id(kind, source)
        head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Refers-To", source), ("WARC-Target-URI", target), ("WARC-Date", named.get("warc-date", DATE)), ("WARC-Source-Payload-Digest", paid), ("Content-Type", type_)]
        out.append((kind, name, source, target, content, record(head, content)))
    return out


def response_of(page_id, url: str | None, page: str | None) -> bytes:
    payload = (page or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), url or "")), ("WARC-Target-URI", url or ""), ("WARC-Date", DATE), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")]
    return record(head, block)


def _per_row(df: DataFrame, one, schema: str, types: list) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounds the records held at once
                part = batch.slice(at, 256)
                rows = [(k, *r) for k, row in enumerate(zip(*(c.to_pylist() for c in part.columns[1:]))) for r in one(*row)]
                columns = [list(x) for x in zip(*rows)] if rows else [[] for _ in range(len(types) + 1)]
                ids = part.column(0).take(pa.array(columns[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(columns[1:], types))], names)

    return df.mapInArrow(run, schema)


def responses(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, record``: a WARC response record of each page."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(page_id).cast("string").alias("name"), F.col(url).alias("url"), F.col(page).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return _per_row(rows, lambda i, u, h: [(response_of(i, u, h),)], f"page_id {kind}, record binary", [pa.binary()])


def derivatives(records: DataFrame, *, key: str = "page_id", data: str = "record") -> DataFrame:
    """``key, kind, record_id, refers_to, target_uri, content, record`` for every response in ``data``: WARC bytes of one record or many (null: none)."""
    rows = records.select(F.col(key).alias(key), F.col(data).alias("_data"))
    kind = rows.schema[key].dataType.simpleString()

    def one(raw):
        for headers, block in parse_records(bytes(raw or b"")):
            if any(k.lower() == "warc-type" and v == "response" for k, v in headers):
                yield from derive(headers, block)

    schema = f"{key} {kind}, kind string, record_id string, refers_to string, target_uri string, content binary, record binary"
    return _per_row(rows, one, schema, [pa.string()] * 4 + [pa.binary()] * 2)


def members(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with the record as a gzip member of its own; members one after another are a WARC file."""
    packed = records.select(F.col(record).alias("_in"), *records.columns)
    out = packed.schema.names[1:]

    def run(batches):
        for batch in batches:
            data = []
            for x in batch.column(0).to_pylist():
                c = zlib.compressobj(6, zlib.DEFLATED, 31)
                data.append(c.compress(x) + c.flush())
            yield pa.RecordBatch.from_arrays([*(pa.array(data, pa.binary()) if n == record else batch.column(i + 1) for i, n in enumerate(out))], out)

    return packed.mapInArrow(run, records.schema)


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derivatives(responses(table(spark, sf_dir, "pages")))
    return made.select("page_id", "kind", "record_id", "refers_to", "target_uri", F.length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("content_sha256"), F.sha2("record", 256).alias("record_sha256"))


QUERIES = {"op4_warc_derivatives": op4_warc_derivatives}
ORACLE_SQL: dict[str, str] = {}
