"""Chunks of documents, their identity and the content hash."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.batches import parts
from quarrylight.functions.text import normalize_lines, text_or_empty

SIZE, OVERLAP, TAIL, LEAST = 3500, 350, 700, 500
_ENDS = (". ", "! ", "? ", "; ", "\n")


def cut(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most `size` characters that end at the last separator of their tail, and overlap."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            least = min(start + LEAST, len(text))
            ends = [p + len(s) for s in _ENDS if (p := text.rfind(s, max(least, end - TAIL), end)) >= least]
            end = max(ends, default=end)
        if piece := text[start:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """pages (url, page_number, text) to url, page_number, chunk_number (over all pages of a URL), text and chunk_id."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap is below the size")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts(batch, 2)):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([cut(t, size, overlap) for t in part.column(2).to_pylist()], pa.list_(pa.string()))], ["url", "page_number", "pieces"])

    clean = pages.select("url", F.col("page_number").cast("int"), normalize_lines(F.col("text")).alias("text"))
    pieces = clean.mapInArrow(run, "url string, page_number int, pieces array<string>").select("url", "page_number", F.posexplode("pieces").alias("place", "text"))
    order = Window.partitionBy("url").orderBy("page_number", "place")
    return pieces.withColumn("chunk_number", F.row_number().over(order)).withColumn("chunk_id", chunk_id(F.col("url"), F.col("page_number"), F.col("chunk_number"))).drop("place")


def chunk_id(url: Column, page: Column, number: Column) -> Column:
    """The same chunk has the same id in every run."""
    return F.sha2(F.concat_ws("\0", url, page.cast("string"), number.cast("string")), 256)


# Sets of page numbers in the hash, in their order.
PAGE_SETS = ("OCR_PAGES", "OCR_ATTEMPTED_PAGES", "OCR_REJECTED_PAGES", "OCR_TIMED_OUT_PAGES", "OCR_BUDGET_SKIPPED_PAGES", "OCR_DEFERRED_PAGES", "UNREADABLE_PAGES")


def content_hash(title: Column, section: Column, category: Column, site_section: Column, published: Column, number: Column, date: Column, kind: Column, attachments: Column, pages: Column, version: Column | None = None, page_sets: dict[str, Column] | None = None) -> Column:
    """SHA-256 over the metadata lines, attachments (array<struct<url, title>>) by URL, and pages (array<struct<page_number, text>>).

    A document with an extraction version has a line for it and for each set of
    page numbers of PAGE_SETS (array<int>, in their order), after its metadata.
    """
    names = ("TITLE", "SECTION", "CONTENT_CATEGORY", "SITE_SECTION", "PUBLISHED_AT", "DOCUMENT_NUMBER", "DOCUMENT_DATE", "DOCUMENT_KIND")
    lines = F.array(*[F.concat(F.lit(n + ":"), text_or_empty(c)) for n, c in zip(names, (title, section, category, site_section, published, number, date, kind))])
    if version is not None:
        sets = page_sets or {}
        empty = F.array().cast("array<int>")
        told = [F.concat(F.lit(n + ":"), F.array_join(F.coalesce(sets[n], empty) if n in sets else empty, ",")) for n in PAGE_SETS]
        more = F.array(F.concat(F.lit("EXTRACTION_VERSION:"), version), *told)
        lines = F.when(F.coalesce(version, F.lit("")) != "", F.concat(lines, more)).otherwise(lines)
    links = F.transform(F.array_sort(attachments), lambda a: F.concat(F.lit("ATTACHMENT:"), a["url"], F.lit("|"), a["title"]))
    body = F.array_join(F.transform(pages, lambda p: F.concat(F.lit("PAGE:"), p["page_number"].cast("string"), F.lit("\n"), p["text"])), "\n\f\n")
    return F.sha2(F.concat(F.array_join(F.concat(lines, links), "\n"), F.lit("\n\f\n"), body), 256)


def chunk_documents(pieces: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with what the index knows of their document.

    documents has one row for each url: doc_type, title, parts of the act, the
    parent page, and the numbers of recognised (ocr_pages) and unreadable pages.
    Files take number, date and kind from what was read out for them, pages fall
    back on the queue's values; files without a category take their parent's.
    """
    from quarrylight.functions.titles import canonical_number_or_null
    from quarrylight.functions.urls import crawl_category

    is_file = F.col("doc_type").isin("pdf", "file")
    doc = documents
    for c in ("document_number", "document_date", "document_kind"):
        doc = doc.withColumn(c, F.when(is_file, F.col(c)).otherwise(F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"row_{c}")))).drop(f"row_{c}")
    parent = F.coalesce(F.nullif("parent_url", F.lit("")), F.nullif("page_url", F.lit("")))
    category = F.coalesce(F.nullif("content_category", F.lit("")), F.when(is_file & parent.isNotNull(), crawl_category(parent)))
    doc = doc.withColumns({"content_category": category, "document_number_normalized": canonical_number_or_null(F.col("document_number")), "sort_date": F.coalesce(F.nullif("document_date", F.lit("")), F.col("published_at")), "is_attachment": is_file})
    joined = pieces.join(doc, "url")
    ocr = F.array_contains("ocr_pages", F.col("page_number"))
    how = F.when(ocr, "ocr").when(F.array_contains("unreadable_pages", F.col("page_number")), "metadata_only").otherwise("native")
    return joined.withColumns({"ocr_used": ocr, "text_extraction": how, "ocr_page_count": F.size("ocr_pages"), "unreadable_page_count": F.size("unreadable_pages")})
