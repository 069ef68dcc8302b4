"""Documents of several formats to text, in Arrow batches.

`extract` dispatches by type and name and returns one struct for each document;
a document that can't be read has an error instead of failing its task.  PDF and
raster pages need libraries that aren't here: they are reported as such, and the
decisions about recognised pages are in `operators.reports`.
"""

from __future__ import annotations

import gzip
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.urls import content_type, path, suffix

from . import page_html
from .page_html import lines

# Groups that RTF readers skip.
RTF_GROUPS = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "themedata", "colorschememapping", "latentstyles", "datastore", "xmlnstbl", "listtable", "listoverridetable", "rsidtbl", "generator", "header", "footer"}
_SCHEMA = "format string, title string, section string, published string, pages array<struct<page_number:int,text:string>>, links array<struct<url:string,title:string>>, attachments array<struct<url:string,title:string>>, error string"


def html(body: bytes, url: str = "") -> dict:
    return page_html.read(decode(body), url)


def decode(body: bytes) -> str:
    """UTF-8, else Windows-1251, else UTF-8 with replacements; no byte-order mark."""
    for encoding in ("utf-8-sig", "cp1251"):
        try:
            return body.decode(encoding)
        except UnicodeDecodeError:
            pass
    return body.decode("utf-8", "replace")


def plain(body: bytes) -> dict:
    return {"pages": [lines(decode(body))]}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def docx(body: bytes) -> dict:
    """Paragraphs first, then the tables' rows with their cells joined by bars."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(body)).read("word/document.xml"))
    text = lambda e: "".join(x.text or "" if _local(x.tag) == "t" else "\t" if _local(x.tag) == "tab" else "" for x in e.iter())
    holder = next(e for e in root if _local(e.tag) == "body")
    out = [text(e) for e in holder if _local(e.tag) == "p"]
    for row in (r for r in holder.iter() if _local(r.tag) == "tr"):
        cells = [" ".join(text(c).split()) for c in row if _local(c.tag) == "tc"]
        out.append(" | ".join(c for c in cells if c))
    return {"pages": [lines("\n".join(out))]}


def xlsx(body: bytes) -> dict:
    """A page for each sheet, beginning with its name."""
    z = zipfile.ZipFile(io.BytesIO(body))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
    names = [e.attrib.get("name", "") for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
    files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    pages = []
    for name, file in zip(names, files):
        rows = []
        for row in (r for r in ET.fromstring(z.read(file)).iter() if _local(r.tag) == "row"):
            cells = []
            for c in row:
                v = "".join(x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t"))
                cells.append(shared[int(v)] if c.attrib.get("t") == "s" and v else v)
            rows.append(" | ".join(x for x in cells if x))
        pages.append(lines("\n".join([f"Лист: {name}", *rows])))
    return {"pages": pages}


def opendocument(body: bytes) -> dict:
    """Paragraphs, headings, rows and list items end lines; cells end with a tab."""
    root, out = ET.fromstring(zipfile.ZipFile(io.BytesIO(body)).read("content.xml")), []

    def walk(e: ET.Element) -> None:
        tag = _local(e.tag)
        out.append({"s": " ", "tab": "\t", "line-break": "\n"}.get(tag, "") + (e.text or ""))
        for child in e:
            walk(child)
            out.append(child.tail or "")
        out.append({"p": "\n", "h": "\n", "table-row": "\n", "list-item": "\n", "table-cell": "\t"}.get(tag, ""))

    walk(root)
    text = "".join(out)
    return {"pages": [lines(re.sub(r"\n\t", "\t", text))]}


def rtf(body: bytes) -> dict:
    """Text outside the service groups; \\u and \\' escapes, breaks and tabs."""
    raw, out, stack, skip, after = body.decode("latin-1"), [], [], False, 1
    pending = 0
    for m in re.finditer(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|[\r\n]+|([^\\{}\r\n]+)", raw, re.S):
        word, number, code, symbol, brace, text = m.groups()
        if brace == "{":
            stack.append((skip, after))
        elif brace == "}":
            skip, after = stack.pop() if stack else (False, 1)
        elif word in RTF_GROUPS or symbol == "*":
            skip = True
        elif skip:
            continue
        elif word == "uc":
            after = int(number or 1)
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            pending = after
        elif word:
            out.append({"par": "\n", "line": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–"}.get(word, ""))
        elif code:
            out.append("" if pending else bytes([int(code, 16)]).decode("cp1251", "replace"))
            pending = max(0, pending - 1)
        elif symbol:
            out.append({"~": " ", "_": "-", "-": ""}.get(symbol, symbol if symbol in "{}\\" else ""))
        elif text:
            out.append(text[pending:])
            pending = max(0, pending - len(text))
    return {"pages": [lines("".join(out))]}


#: What stands in `error` of a document whose pages can't be read here: its row keeps what its name tells.
METADATA_ONLY = "metadata only: no PDF library here, pass recognised pages as a table"


def pdf(body: bytes, url: str = "") -> dict:
    """A row without pages, titled by its file name: what a reader that ran out of time leaves."""
    return {"title": page_html.file_name(url), "section": "", "error": METADATA_ONLY}


READERS = {"pdf": pdf, "docx": docx, "xlsx": xlsx, "rtf": rtf, "odf": opendocument, "html": html, "text": plain}


def document_format(kind: Column, url: Column) -> Column:
    """The reader for a content type and URL, in the order of the readers; null if there is none."""
    t, s = content_type(kind), suffix(path(url))
    out = F.when(F.contains(t, F.lit("pdf")) | (s == ".pdf"), "pdf").when(F.contains(t, F.lit("wordprocessingml")) | (s == ".docx"), "docx").when(F.contains(t, F.lit("spreadsheetml")) | (s == ".xlsx"), "xlsx")
    out = out.when(F.contains(t, F.lit("rtf")) | (s == ".rtf"), "rtf").when(F.contains(t, F.lit("opendocument")) | s.isin(".odt", ".ods"), "odf").when(F.contains(t, F.lit("html")), "html")
    return out.when(t.isin("text/plain", "text/csv") | s.isin(".txt", ".csv"), "text").when((t == "") & s.isin("", ".php", ".html", ".htm"), "html")


def extract(files: DataFrame) -> DataFrame:
    """files (url, content_type, content binary) to url and what the readers find; lost or broken documents have an error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, kind, body in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found, error = {}, None
                try:
                    found = {} if not kind else READERS[kind](body or b"", url or "") if kind in ("html", "pdf") else READERS[kind](body or b"")
                    error = found.get("error") if kind else "unsupported format"
                except Exception as e:  # a broken document is a row, not a failed task
                    error = f"{type(e).__name__}: {e}"[:200]
                rows.append({"format": kind, "title": found.get("title"), "section": found.get("section"), "published": found.get("published"), "pages": [{"page_number": n, "text": t} for n, t in enumerate(found.get("pages", []), 1)], "links": [{"url": u, "title": t} for u, t in found.get("links", [])], "attachments": [{"url": u, "title": t} for u, t in found.get("attachments", [])], "error": error})
            kinds = pa.struct([("format", pa.string()), ("title", pa.string()), ("section", pa.string()), ("published", pa.string()), ("pages", pa.list_(pa.struct([("page_number", pa.int32()), ("text", pa.string())]))), ("links", pa.list_(pa.struct([("url", pa.string()), ("title", pa.string())]))), ("attachments", pa.list_(pa.struct([("url", pa.string()), ("title", pa.string())]))), ("error", pa.string())])
            yield pa.RecordBatch.from_arrays([batch.column(0), *pa.array(rows, kinds).flatten()], ["url", *[f.name for f in kinds]])

    return files.select("url", document_format(F.col("content_type"), F.col("url")).alias("format"), "content").mapInArrow(run, f"url string, {_SCHEMA}")


#: Bytes that a gzipped sitemap may inflate to.
MOST_INFLATED = 64 << 20


def _inflated(body: bytes) -> bytes:
    if body[:2] != b"\x1f\x8b":
        return body
    with gzip.GzipFile(fileobj=io.BytesIO(body)) as f:
        raw = f.read(MOST_INFLATED + 1)
    if len(raw) > MOST_INFLATED:
        raise ValueError("a sitemap that inflates beyond its bound")
    return raw


def sitemap(body: bytes) -> tuple[list[str], list[tuple[str, str | None]]]:
    """(sitemaps, (page, lastmod) pairs) of a sitemap or sitemap index, plain or gzipped, whatever its namespace."""
    root = ET.fromstring(_inflated(body))
    maps, pages = [], []
    for e in root:
        parts = {_local(x.tag): (x.text or "").strip() for x in e}
        if parts.get("loc"):
            if _local(e.tag) == "sitemap":
                maps.append(parts["loc"])
            elif _local(e.tag) == "url":
                pages.append((parts["loc"], parts.get("lastmod")))
    return maps, pages


def robots_rules(text: str) -> RobotFileParser:
    """The allow and deny rules of a robots.txt: `can_fetch(agent, url)`."""
    rules = RobotFileParser()
    rules.parse(text.splitlines())
    return rules


def allowed(urls: DataFrame, text: str, agent: str = "*") -> DataFrame:
    """Rows (url) that a robots.txt allows an agent to fetch; the rules are one small file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = robots_rules(text)
        for batch in batches:
            at = batch.schema.get_field_index("url")
            yield batch.filter(pa.array([u is not None and rules.can_fetch(agent, u) for u in batch.column(at).to_pylist()], pa.bool_()))

    return urls.mapInArrow(run, urls.schema)


def robots(text: str) -> list[str]:
    """Sitemaps that a robots.txt names."""
    return [m.strip() for m in re.findall(r"(?im)^\s*sitemap:\s*(\S+)", text)]
