"""WARC derivative builder: responses to linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import arrow_rows

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
#: Headers of a response that its derivatives repeat.
NEEDED = ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest", "WARC-Block-Digest")
_space = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # name space of URLs (RFC 4122)

_cut = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<![^>]*>|<\?[^>]*>", re.I | re.S).sub
_block = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|title|head|body|html|blockquote|pre|form|dl|dt|dd|main|aside|figure|hr|td|th|option)\b[^>]*>", re.I).sub
_tag = re.compile(r"</?[A-Za-z][^>]*>").sub
_blank = re.compile(r"[^\S\n]+").sub
_lines = re.compile(r" ?\n[ \n]*").sub
_title = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S).search
_link = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I).findall
_charset = re.compile(r"<meta\b[^>]*?\bcharset\s*=\s*[\"']?([\w-]+)", re.I).search
_language = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I).search


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(page: str) -> str:
    """Visible text: scripts, styles, comments and tags away, one line for each block, entities resolved."""
    text = _tag("", _block("\n", _cut("", page)))
    return _lines("\n", _blank(" ", html.unescape(text).replace("\xa0", " "))).strip()


def identifier(kind: str, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_space, kind + ' ' + name)}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", *[f"{k}: {_one_line(v)}" for k, v in headers], f"WARC-Block-Digest: {digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Headers (with the version under '') and block of each record; raises ValueError on a broken one."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not all(": " in x for x in lines):
            raise ValueError("broken header")
        headers = {"": first} | dict(x.split(": ", 1) for x in lines)
        if not headers.get("Content-Length", "").isdecimal():
            raise ValueError("no content length")
        size = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if not first.startswith("WARC/") or len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("broken record")
        out.append((headers, block))
        at = end + 8 + size
    return out


def response(page_id, url: str, page: str, date: str = DATE) -> bytes:
    """A response record of a stored page: HTTP head and entity, as a crawler would have written it.

    Its identifier follows from id, URL, date and content: other content, another identifier.
    """
    entity = page.encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(entity)).encode() + b"\r\n\r\n" + entity
    headers = [("WARC-Record-ID", identifier("response", f"{page_id} {date} {digest(entity)} {url}")), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest(entity)), ("Content-Type", "application/http; msgtype=response")]
    return record("response", headers, http)


def derive(source: bytes) -> tuple[bytes, bytes]:
    """Metadata and conversion records of a response record, each referring to it."""
    records = parse(source)
    if len(records) != 1:
        raise ValueError(f"{len(records)} records")
    ((headers, block),) = records
    if headers.get("WARC-Type") != "response":
        raise ValueError("not a response")
    if missing := [x for x in NEEDED if x not in headers]:
        raise ValueError(f"no {missing[0]}")
    head, _, entity = block.partition(b"\r\n\r\n")
    page = entity.decode("utf-8", "replace")
    origin, uri = headers["WARC-Record-ID"], headers["WARC-Target-URI"]
    status, *fields = head.decode("latin-1").split("\r\n")
    title, lang, charset = _title(page), _language(page), _charset(page)
    links = [html.unescape(x.strip("\"'")) for x in _link(page)]
    facts = [("sourceStatus", status), *[("sourceHeader", x) for x in fields], ("sourcePayloadDigest", headers["WARC-Payload-Digest"]), ("sourceBlockDigest", headers["WARC-Block-Digest"])]
    facts += [(k, html.unescape(_one_line(m[1])).strip()) for k, m in (("title", title), ("language", lang), ("charset", charset)) if m]
    facts += [("outlink", x) for x in links]
    common = [("WARC-Date", headers["WARC-Date"]), ("WARC-Target-URI", uri), ("WARC-Refers-To", origin), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", headers["WARC-Date"])]
    body = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in facts).encode("utf-8", "replace")
    meta = record("metadata", [("WARC-Record-ID", identifier("metadata", origin)), *common, ("Content-Type", "application/warc-fields")], body)
    text = plain_text(page).encode("utf-8", "replace")
    conversion = record("conversion", [("WARC-Record-ID", identifier("conversion", origin)), *common, ("WARC-Source-Payload-Digest", headers["WARC-Payload-Digest"]), ("WARC-Payload-Digest", digest(text)), ("Content-Type", "text/plain; charset=utf-8")], text)
    return meta, conversion


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str | None = None) -> DataFrame:
    """Rows ``(page_id, record)``: a response record of each page; null URLs and pages count as empty.

    ``date`` names a column of WARC dates; without it, and where it is null, the date is ``DATE``.
    Pages that differ in any of these have other record ids; repeated rows are one page fetched twice and
    share theirs; an empty table gives no rows; other columns are ignored.
    """

    def rows(keys, urls, dates, bodies):
        yield {"page_id": keys, "record": [response(k, u or "", b or "", d or DATE) for k, u, d, b in zip(keys, urls, dates, bodies)]}

    when = F.col(date).cast("string") if date else F.lit(None).cast("string")
    source = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), when.alias("date"), F.col(page).cast("string").alias("html"))
    return arrow_rows(source, rows, "page_id long, record binary", sized="html")


RECORDS = "page_id long, kind string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, source_payload_digest string, block_digest string, block_bytes long, record binary, error string"


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for each response record, ``metadata`` and ``conversion``: fields of their headers and the record itself.

    A null record gives no rows.  A broken record, an empty one and one of another kind give one row of
    kind ``error`` with what is wrong in ``error``, which is null for all others.  Repeated rows stay; an
    empty table gives no rows; other columns are ignored.
    """

    def rows(keys, values):
        names = [x.split()[0] for x in RECORDS.split(", ")]
        out: dict[str, list] = {n: [] for n in names}
        for key, value in zip(keys, values):
            if value is None:
                continue
            try:
                made = derive(value)
                origin = parse(value)[0][0]
            except ValueError as e:
                for n in names:
                    out[n].append({"page_id": key, "kind": "error", "error": str(e)}.get(n))
                continue
            for derived in made:
                ((h, block),) = parse(derived)
                for n, x in zip(names, (key, h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Target-URI"], h["WARC-Date"], h["Content-Type"], origin["WARC-Payload-Digest"], h["WARC-Block-Digest"], len(block), derived, None)):
                    out[n].append(x)
        yield out

    return arrow_rows(records.select("page_id", "record"), rows, RECORDS)
