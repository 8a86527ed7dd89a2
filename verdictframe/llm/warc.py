"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Each response row (a captured page) yields one metadata record and one conversion record. Both are complete WARC/1.1
records (header lines, blank line, block, two line ends) that carry the response's record id in WARC-Refers-To, its
target URI and date, and digests: of the response's payload (WARC-Refers-To-Payload-Digest) and of their own block.
The metadata block preserves the response's own header lines, if a column holds them, under a "source-" prefix, and
what the page declares of itself (charset, language). Record ids are name-based, so a task that runs again writes the
same records. Pages are read by one pass over their tags, in time proportional to their length whatever they hold.

Rows are independent: no shuffle, and a lost executor costs only its tasks.

Defined results: a null page counts as an empty one; an empty text gives a conversion record with an empty block; a
null URL leaves out WARC-Target-URI, a null date (or none) WARC-Date, and null headers the lines they would give.
Comments, scripts and styles that don't end reach to the end of the page; a tag that doesn't end is text. Repeated rows
give repeated records with equal ids. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.cluster import only

RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, block_digest string, content_length long, record binary"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
VERSION = "WARC/1.1"

#: Elements whose content is no text, and those that end a line.
RAW, HIDDEN = {"script", "style"}, {"noscript", "template"}
BREAKS = {"br", "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "tr", "table", "article", "section", "header", "footer", "nav", "title", "blockquote", "pre", "td", "th"}

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_TURN = re.compile(r">|=\s*[\"']")
_END = {name: re.compile(rf"</{name}(?![^\s/>])", re.I) for name in RAW | HIDDEN}
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_LANG = re.compile(r"\slang\s*=\s*[\"']?([\w-]+)", re.I)
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


class _Ends:
    """Where tags end: at the first > outside quoted values, as long as the quotes of the page close."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def after(self, at: int) -> int:
        """The place behind the tag that begins at at; -1 if it doesn't end."""
        place = at
        while self.quotes:
            turn = _TURN.search(self.page, place)
            if turn is None:
                break
            if turn[0] == ">":
                return turn.end()
            place = self.page.find(turn[0][-1], turn.end()) + 1
            if not place:
                break
        self.quotes = False  # from here on quotes are plain characters, so no part of the page is read again and again
        return self.page.find(">", at) + 1 or -1


def read_page(page: str) -> tuple[str, list[tuple[str, str]]]:
    """The text of a page (without markup, scripts and styles, entities resolved, a line for each block element), and what it declares."""
    out, declared, at, ends = [], {}, 0, _Ends(page)
    while (tag := page.find("<", at)) >= 0:
        out.append(page[at:tag])
        if page.startswith("<!--", tag):
            out.append(" ")
            at = tag + 5 if page.startswith(">", tag + 4) else tag + 6 if page.startswith("->", tag + 4) else 0
            if not at:  # <!--> and <!---> are comments already
                end = page.find("-->", tag + 4)
                at = end + 3 if end >= 0 else len(page)
            continue
        name_found = _NAME.match(page, tag)
        if not name_found and page[tag + 1 : tag + 2] not in ("!", "?", "/"):
            out.append("<")
            at = tag + 1
            continue
        end = ends.after(tag)
        if end < 0:
            at = tag
            break
        name = name_found[1].lower() if name_found else ""
        opens, at = page[tag + 1] != "/", end
        if name in BREAKS:
            out.append("\n")
        elif opens and name in _END and (name in RAW or name not in declared):
            closing = _END[name].search(page, end)
            out.append(" ")
            if closing:
                at = max(ends.after(closing.start()), closing.end())
            elif name in RAW:
                at = len(page)
            else:
                declared[name] = ""  # no later one ends, either
        elif opens and name in ("meta", "html"):
            key, pattern = ("charset", _CHARSET) if name == "meta" else ("content-language", _LANG)
            if key not in declared and (m := pattern.search(page, tag, end)):
                declared[key] = m[1].lower() if name == "meta" else m[1]
    out.append(page[at:])
    text = _LINES.sub("\n", _BLANKS.sub(" ", entities.unescape("".join(out)).replace("\xa0", " ")))
    return text.strip(), [(k, declared[k]) for k in ("charset", "content-language") if k in declared]


def plain_text(page: str) -> str:
    return read_page(page)[0]


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join(parts))}>"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record(kind: str, headers: list[tuple[str, str | None]], content_type: str, block: bytes) -> bytes:
    """A complete record; headers without a value are left out."""
    lines = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {_one_line(v)}" for k, v in headers if v is not None), f"Content-Type: {content_type}", f"WARC-Block-Digest: {digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the block of a record, as record() writes it."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != VERSION:
        raise ValueError(f"not a {VERSION} record: {version[:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines)
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the block doesn't end where Content-Length says")
    return headers, rest[:n]


def source_headers(headers: str | None) -> list[tuple[str, str]]:
    """(name, value) of the header lines of a response, a status line as status; lines that are neither are left out."""
    found = []
    for k, line in enumerate((headers or "").splitlines()):
        name, colon, value = line.partition(":")
        if not k and line.startswith("HTTP/"):
            found.append(("status", line))
        elif colon and name.strip():
            found.append((name.strip().lower(), value.strip()))
    return found


def derivatives(page_id: int | None, url: str | None, page: str | None, date: str | None, headers: str | None) -> list[tuple]:
    """The metadata and the conversion record of a response, as rows of RECORD."""
    raw = (page or "").encode()
    payload = digest(raw)
    response = record_id("response", str(page_id), url or "", payload)
    plain, declared = read_page(page or "")
    text = plain.encode()
    fields = [f"source-{k}: {_one_line(v)}" for k, v in source_headers(headers)] + [f"declared-{k}: {_one_line(v)}" for k, v in declared]
    metadata = "\r\n".join([*fields, f"payload-length: {len(raw)}", f"text-length: {len(text)}", f"text-digest: {digest(text)}"]).encode() + b"\r\n"
    rows = []
    for kind, content_type, block in (("metadata", "application/warc-fields", metadata), ("conversion", "text/plain; charset=utf-8", text)):
        own = record_id(kind, response)
        lines = [("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Refers-To", response), ("WARC-Refers-To-Payload-Digest", payload)]
        rows.append((page_id, kind, own, response, url, payload, digest(block), len(block), record(kind, lines, content_type, block)))
    return rows


_TYPES = [("page_id", pa.int64()), *((n, pa.string()) for n in ("record_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest")), ("content_length", pa.int64()), ("record", pa.binary())]


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            rows = [r for row in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True) for r in derivatives(*row)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_TYPES)], names=[n for n, _ in _TYPES])


def build(pages: DataFrame, date: str | None = None, headers: str | None = None) -> DataFrame:
    """The derivative records of pages (page_id, url, html; date and headers name columns of WARC dates and header lines)."""
    given = [c for c in (date, headers) if c]
    named = only(pages, "page_id", "url", "html", *dict.fromkeys(given))

    def text(column: str | None, name: str) -> Column:
        return (F.col(f"`{column}`") if column else F.lit(None)).cast("string").alias(name)

    rows = named.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", text(date, "date"), text(headers, "headers"))
    return rows.mapInArrow(_derived, RECORD)
