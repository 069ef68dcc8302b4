"""Catalogue queries over extraction, presentation and streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import legal
from quarrylight.functions.text import compact
from quarrylight.operators import chunking, present
from quarrylight.operators import search as S
from quarrylight.sources import formats
from quarrylight.streaming import leases

from .search_queries import LANGUAGES, SEARCH_SQL, SEARCHED, chunks


def _files(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("url", F.lit("text/html; charset=utf-8").alias("content_type"), F.encode("html", "utf-8").alias("content"))


def q_extract_html(spark: SparkSession, d: str) -> DataFrame:
    """Title, main text and links of every page."""
    found = formats.extract(_files(spark, d))
    words = compact(F.get("pages", F.lit(0))["text"])
    return found.select("url", "format", "title", "section", F.sha2(words, 256).alias("text_sha256"), F.size("links").cast("long").alias("links"), F.size("attachments").cast("long").alias("attachments"), "published", "error")


def q_page_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Number, date and kind of whole texts, with labels put before every fourth and an element id into every sixth URL."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    label = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Номер документа: "), F.col("doc_id").cast("string"), F.lit("-р\nДата документа\n03.02.2021\nТип документа: приказ\n"))).otherwise(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Решение от 5 мая 2020 № "), F.col("doc_id").cast("string"), F.lit("\n"))).otherwise(""))
    url = F.concat(F.lit("https://h/a"), F.when(F.col("doc_id") % 6 == 0, "?ELEMENT_ID=1").otherwise(""))
    return docs.select("doc_id", legal.page_metadata(F.concat(label, F.coalesce("text", F.lit(""))), url).alias("m")).select("doc_id", "m.number", "m.date", "m.kind")


def q_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return leases.counts_by_window(spark.read.parquet(f"{d}/events.parquet"))


def q_snippet(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return present.snippets(docs, SNIPPED).select("doc_id", "snippet")


SNIPPED = "thornxyz of the"


def q_answer(spark: SparkSession, d: str) -> DataFrame:
    """The extractive answer over the longest documents: score, snippet, cuts and equal snippets."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    items = docs.select(F.col("n_chars").cast("double").alias("score"), F.col("doc_id").cast("string").alias("url"), F.lit("t").alias("title"), F.coalesce("text", F.lit("")).alias("snippet"))
    return present.answer(items).select("answer", "source_count")


def q_results(spark: SparkSession, d: str) -> DataFrame:
    """A page of the search as results, with the fields that don't depend on how a text is cut."""
    index = S.build_index(chunks(spark, d))
    shown = present.results(S.search(index, SEARCHED, category="en", categories=LANGUAGES).items, SEARCHED)
    return shown.select("id", "url", F.round("score", 6).alias("score"), "content_category", "ocr_used")


def q_content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hashes with an extraction version on every second document."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    nothing, pages = F.lit(""), F.array(F.struct(F.lit(1).alias("page_number"), F.coalesce("text", F.lit("")).alias("text")))
    links = F.array(F.struct(F.lit("u2").alias("url"), F.lit("b").alias("title")), F.struct(F.lit("u1").alias("url"), F.lit("a").alias("title")))
    version = F.when(F.col("doc_id") % 2 == 0, "7")
    found = chunking.content_hash(F.col("source"), F.col("lang"), nothing, nothing, F.lit(None), nothing, nothing, nothing, links, pages, version, {"OCR_PAGES": F.array(F.lit(1), F.lit(3)), "UNREADABLE_PAGES": F.array(F.lit(2))})
    return docs.select("doc_id", found.alias("hash"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
_ARTICLE = r"regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)"
_PLAIN = r"replace(replace(regexp_replace(regexp_replace({x}, '</?(p|h1|br|div|li)[^>]*>', ' ', 'g'), '<[^>]+>', '', 'g'), '&quot;', '\"'), '&amp;', '&')"
_SPACED = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
_SQUEEZED = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
ORACLE = {
    "q_window_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL",
    "q_extract_html": f"SELECT url, 'html' AS format, {_SPACED.format(x=_PLAIN.format(x='regexp_extract(' + _ARTICLE + ', ' + chr(39) + '(?s)<h1>(.*?)</h1>' + chr(39) + ', 1)'))} AS title, '' AS section, sha256({_SPACED.format(x=_PLAIN.format(x=_ARTICLE))}) AS text_sha256, "
    "len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1))) AS links, 0 AS attachments, CAST(NULL AS VARCHAR) AS published, CAST(NULL AS VARCHAR) AS error FROM pages",
    "q_page_metadata": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id AS VARCHAR) || '-р' WHEN doc_id % 6 = 3 THEN NULL WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) END AS number, "
    "CASE WHEN doc_id % 4 = 0 THEN '2021-02-03' END AS date, CASE WHEN doc_id % 4 = 0 THEN 'Приказ' WHEN doc_id % 6 = 0 THEN 'Решение' END AS kind FROM documents",
    "q_content_hash": "SELECT doc_id, sha256(array_to_string(['TITLE:' || coalesce(source, ''), 'SECTION:' || coalesce(lang, ''), 'CONTENT_CATEGORY:', 'SITE_SECTION:', 'PUBLISHED_AT:', 'DOCUMENT_NUMBER:', 'DOCUMENT_DATE:', 'DOCUMENT_KIND:'], chr(10)) || "
    "CASE WHEN doc_id % 2 = 0 THEN chr(10) || array_to_string(['EXTRACTION_VERSION:7', 'OCR_PAGES:1,3', 'OCR_ATTEMPTED_PAGES:', 'OCR_REJECTED_PAGES:', 'OCR_TIMED_OUT_PAGES:', 'OCR_BUDGET_SKIPPED_PAGES:', 'OCR_DEFERRED_PAGES:', 'UNREADABLE_PAGES:2'], chr(10)) ELSE '' END || "
    "chr(10) || 'ATTACHMENT:u1|a' || chr(10) || 'ATTACHMENT:u2|b' || chr(10) || chr(12) || chr(10) || 'PAGE:1' || chr(10) || coalesce(text, '')) AS hash FROM documents",
    "q_answer": f"WITH t AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR)) AS k FROM documents), s AS (SELECT k, {_SQUEEZED} AS x FROM t WHERE k <= 5), f AS (SELECT k, x FROM s WHERE x <> '' AND NOT EXISTS (SELECT 1 FROM s AS e WHERE e.k < s.k AND lower(e.x) = lower(s.x))) "
    "SELECT 'По наиболее релевантным материалам:' || chr(10) || chr(10) || string_agg('• ' || CASE WHEN length(x) <= 340 THEN x ELSE rtrim(left(x, 340), ' ,.;:-') || '…' END, chr(10) || chr(10) ORDER BY k) AS answer, (SELECT count(*) FROM s) AS source_count FROM f",
    "q_results": SEARCH_SQL + "SELECT CAST(doc_id AS VARCHAR) AS id, url, round(score, 6) AS score, lang AS content_category, false AS ocr_used FROM hit WHERE lang = 'en' QUALIFY row_number() OVER (PARTITION BY url ORDER BY score DESC, doc_id) = 1 ORDER BY score DESC, url LIMIT 10",
}
