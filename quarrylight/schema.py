"""Schemas of the state tables and of chunks, and the gate that keeps them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "float": T.FloatType(), "date": T.DateType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


#: One row for each URL; times are ISO strings, which order as times do.
CRAWL_URLS = _struct(
    "url string, page_url string, file_url string, source string, doc_type string, content_type string, content_hash string, extraction_version string, status string, http_status int, etag string, last_modified string, "
    "attempt_count int, failure_count int, last_error string, first_seen_at string, last_seen_at string, last_fetched_at string, last_indexed_at string, source_updated_at string, is_active int, "
    "last_checked_at string, next_check_at string, locked_at string, locked_by string, indexed_chunks int, consecutive_missing int, source_hash string, discovered_at string, discovered_from string, sitemap_lastmod string, "
    "document_number string, document_date string, document_kind string, parent_url string, attachment_title string"
)
PUBLICATION_QUEUE = _struct("url string, category string, status string, attempts int, published_at string, es_updated_chunks int, last_http_status int, last_error string, created_at string, updated_at string, locked_at string, locked_by string")
DISCOVERY_RUNS = _struct("id int, started_at string, finished_at string, status string, robots_url string, sitemaps_seen int, sitemap_errors int, candidates_seen int, known_urls int, new_urls_found int, inserted_urls int, message string")
CHUNKS = _struct(
    "url string, page_url string, file_url string, parent_url string, url_path string, source string, doc_type string, content_type string, content_category string, site_section string, hash string, title string, section string, attachment_title string, text string, "
    "document_number string, document_number_normalized string, document_kind string, document_date string, published_at string, sort_date string, fetched_at string, updated_at string, is_attachment boolean, ocr_used boolean, page_number int, chunk_number int, "
    "source_page_count int, ocr_page_count int, ocr_attempted_page_count int, ocr_rejected_page_count int, unreadable_page_count int, extraction_version string, text_extraction string, ocr_confidence float"
)
#: Longer values aren't indexed as keywords.
KEYWORD_LIMITS = {"url": 2048, "page_url": 2048, "file_url": 2048, "parent_url": 2048, "url_path": 1024, "title": 512, "attachment_title": 1024}


def conform(df: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """The columns of the schema in its order and types; missing ones are null.  Strict: unknown columns are refused."""
    unknown = [c for c in df.columns if c not in schema.names]
    if strict and unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def keywords(df: DataFrame) -> DataFrame:
    """df with a column `<name>_key` for each keyword with a limit: null where the value is too long."""
    return df.withColumns({f"{c}_key": F.when(F.length(c) <= n, F.col(c)) for c, n in KEYWORD_LIMITS.items() if c in df.columns})
