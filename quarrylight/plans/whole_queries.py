"""Scalar rules over whole columns of `documents`, `orders` and `pages`, with their oracle SQL.

The tables have no act numbers, acts or URLs of the site, so these are put
before the real text, or made of the row's key; the rest of each value is real.
Literal rows of the same rules are unit tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import analysis, legal, repair, text, titles, urls
from quarrylight.operators import discovery, state

SITE = "city.example"


def _docs(spark: SparkSession, d: str, expression: str) -> DataFrame:
    """doc_id and v: an expression that Spark and DuckDB read alike, with {{s}} for the type of strings."""
    return spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", f"{expression.format(s='STRING')} AS v")


def _sql(expression: str, want: str, rest: str = "") -> str:
    return f"WITH x AS (SELECT doc_id, {expression.format(s='VARCHAR')} AS v, text, source FROM documents) SELECT doc_id, {want} FROM x{rest}"


_ID = "CAST(doc_id AS {s})"
_NUMBER = f"CASE doc_id % 6 WHEN 0 THEN '№ ' || {_ID} || '-р' WHEN 1 THEN {_ID} || ' – Р' WHEN 2 THEN 'N' || {_ID} || '-P' WHEN 3 THEN '  ' || {_ID} || '—р ' WHEN 4 THEN 'No ' || {_ID} || ' -р' ELSE {_ID} || '-ФЗ' END"
_BROKEN = "replace(coalesce(text, ''), ' th', '-\n  th')"
_MIXED = "'Cочи pешение ' || coalesce(text, '')"
_NAME = f"CASE doc_id % 3 WHEN 0 THEN md5({_ID}) || '.docx' WHEN 1 THEN 'plan-' || {_ID} || '.pdf' ELSE source END"
_SHAPE = "CASE WHEN doc_id % 3 = 0 THEN '№ 7 ' ELSE '' END || replace(replace(coalesce(text, ''), 'n', 'm'), 'N', 'M')"
_GUARDED = "CASE doc_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE 'x' END || coalesce(text, '')"
_PARTS = f"{_ID} || '-р ' || source"
_ACT = f"CASE doc_id % 4 WHEN 0 THEN 'Постановление от 14.03.2024 № ' || {_ID} || '-р ' WHEN 1 THEN 'РАСПОРЯЖЕНИЕ от 2 июня 2023 года N ' || {_ID} || ' ' WHEN 2 THEN 'Приказ от 30.02.2024 № 7 ' ELSE '' END || coalesce(text, '')"
_LABEL = f"coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN '\nНомер документа: ' || {_ID} || '-р\n' WHEN 1 THEN '\nномер документа\n ' || {_ID} || ' \nДата документа' WHEN 2 THEN '\nНомер документа\nДата документа' ELSE '' END"
_SCORED = "'«' || coalesce(text, '') || '» – x'"


def _column(expression: str, f):
    return lambda spark, d: _docs(spark, d, expression).select("doc_id", f(F.col("v")).alias("want"))


def q_hyphen(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d, _BROKEN).select("doc_id", F.sha2(repair.join_hyphens(F.col("v")), 256).alias("want"))


def q_repair(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d, _MIXED).select("doc_id", F.sha2(repair.repair(F.col("v")), 256).alias("want"), repair.mixed_count(F.col("v")).cast("long").alias("mixed"))


def q_csv_guard(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d, _GUARDED).select("doc_id", F.sha2(text.csv_guard(F.col("v")), 256).alias("want"))


def q_legal(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d, _ACT).select("doc_id", legal.title_metadata(F.col("v")).alias("m"), legal.header_reliable(F.col("v")).alias("reliable"), legal.header_needs_ocr(F.col("v")).alias("needs_ocr")).select("doc_id", "m.kind", "m.number", "m.date", "reliable", "needs_ocr")


def q_scoring_form(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d, _SCORED).select("doc_id", F.sha2(text.scoring_form(F.col("v")), 256).alias("want"))


def q_strip_tags(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.sha2(text.strip_tags(F.col("html")), 256).alias("want"))


def q_query_words(spark: SparkSession, d: str) -> DataFrame:
    v = _docs(spark, d, "'где найти ' || coalesce(text, '')")
    return v.select("doc_id", F.size(text.query_words(F.col("v"))).cast("long").alias("words"), F.sha2(text.meaningful_query(F.col("v")), 256).alias("want"))


def q_titles(spark: SparkSession, d: str) -> DataFrame:
    """Generic titles, a title from running text, the first that isn't blank."""
    v = _docs(spark, d, f"CASE doc_id % 4 WHEN 0 THEN 'Файл' WHEN 1 THEN 'Скачать документ ' || {_ID} WHEN 2 THEN 'Скачать документ: Приказ' ELSE 'Отчёт ' || {_ID} END")
    return v.select("doc_id", text.is_generic_title(F.col("v")).alias("generic"), text.title_from_text(F.concat(F.lit("шум "), F.col("v"))).alias("title"), text.first_text(F.lit("  "), F.when(F.col("doc_id") % 2 == 0, F.col("v")), F.lit("rest")).alias("first"), titles.canonical_number_or_null(F.col("v").substr(1, 0)).alias("none"))


def q_date_display(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", text.format_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("want"))


_URL = (
    "CASE page_id % 12 WHEN 0 THEN url WHEN 1 THEN 'https://city.example/press-sluzhba/novosti/1/' || {i} || '/' WHEN 2 THEN 'https://city.example/press-sluzhba/obyavleniya/' || {i} WHEN 3 THEN 'http://city.example/content/detail.php?ID=' || {i} WHEN 4 THEN 'https://city.example/upload/' || {i} || '.PDF' "
    "WHEN 5 THEN 'https://city.example/list/?PAGEN_1=' || {i} WHEN 6 THEN 'https://city.example/upload/' || {i} || '.zip' WHEN 7 THEN 'https://city.example/gorodskaya-vlast/normativno-pravovyye-akty/?ELEMENT_ID=' || {i} WHEN 8 THEN 'https://m.city.example/a/../' || {i} WHEN 9 THEN 'https://city.example/gorod/' WHEN 10 THEN 'https://city.example/x/' || CAST(page_id + 10000 AS {s}) ELSE 'https://city.example/f/' || {i} || '.doc' END"
)


def _urls(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").selectExpr("page_id", f"{_URL.format(i='CAST(page_id AS STRING)', s='STRING')} AS u").where("page_id % 12 <> 0")


def q_url_class(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("u")
    return _urls(spark, d).select("page_id", urls.url_class(u).alias("kind"), urls.is_pagination(u).alias("paged"), urls.page_number(u).alias("page"), urls.newest_number(u).alias("newest"), urls.format_bucket(u, F.lit(None)).alias("format"), urls.is_detail(u).alias("detail"))


def q_category(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("u")
    return _urls(spark, d).select("page_id", urls.crawl_category(u).alias("crawl"), urls.display_category(u).alias("display"), urls.reindex_category(u).alias("reindex"))


def q_url_checks(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("u")
    return _urls(spark, d).select("page_id", urls.suspicious(u, SITE).alias("odd"), urls.publication_kind(u).alias("kind"), urls.fetch_url(u, SITE).alias("request"), urls.attachment_url(u, SITE).alias("attachment"), urls.is_archive(u).alias("archive"), urls.is_unsupported_office(u).alias("old_office"), urls.is_legacy_detail(u).alias("legacy"), urls.host_allowed(u, SITE).alias("allowed"))


def q_request_url(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 2 == 0, "pdf").otherwise("page")
    return _urls(spark, d).select("page_id", urls.request_url(kind, F.when(F.col("page_id") % 3 != 0, F.col("u")), F.when(F.col("page_id") % 5 != 0, F.lit("f")), F.lit("p")).alias("url"), urls.is_pdf_response(F.when(F.col("page_id") % 4 == 0, "Application/PDF; q=1"), F.col("u"), F.lit(None).cast("string")).alias("pdf"), urls.content_type(F.when(F.col("page_id") % 4 == 0, " Application/PDF; q=1")).alias("content_type"))


def q_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What sitemap and pages tell, one row for each key, in the order of the queue."""
    u = _urls(spark, d)
    sitemap = u.select(F.col("u").alias("url"), F.lit("sitemap").alias("source"))
    found = u.where("page_id % 2 = 0").select(F.concat("u", F.when(F.col("page_id") % 4 == 0, "#top").otherwise("")).alias("url"), F.lit("html").alias("source"))
    both = discovery.candidates(sitemap, found)
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", "n")


def q_describe(spark: SparkSession, d: str) -> DataFrame:
    return discovery.describe(_urls(spark, d).select(F.col("u").alias("url")), "sitemap").select("url", "doc_type", "page_url", "file_url", "content_type")


def q_labelled(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d, _LABEL).select("doc_id", legal.labelled_value(F.col("v"), "Номер документа").alias("want"))


def q_reconcile(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    url = F.col("o_orderkey").cast("string").alias("url")
    queue = orders.select(url, F.element_at(F.array(*[F.lit(s) for s in ("pending", "done", "not_indexed", "skipped")]), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("status"), (F.col("o_orderkey") % 6).cast("int").alias("attempts"))
    crawled = orders.where("o_orderkey % 3 <> 0").select(url, F.element_at(F.array(*[F.lit(s) for s in ("indexed", "gone", "unchanged", "discovered", "quarantined")]), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("status"), F.when(F.col("o_orderkey") % 7 == 0, 0).otherwise(1).alias("is_active"))
    return state.reconcile(queue, crawled).select("url", "status", "attempts")


def q_inherit(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    rows = orders.selectExpr("CAST(o_orderkey AS STRING) AS url", "CASE WHEN o_orderkey % 3 = 0 THEN 'page' WHEN o_orderkey % 3 = 1 THEN 'pdf' ELSE 'file' END AS doc_type", "CAST(o_orderkey - 1 AS STRING) AS parent_url", "CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey AS STRING) END AS document_number", "o_orderpriority AS document_kind", "CAST(NULL AS STRING) AS document_date")
    return state.inherit(rows).select("url", "document_number", "document_date", "document_kind")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")} | {
    "q_docnum": _column(_NUMBER, repair.document_number),
    "q_techname": _column(_NAME, text.technical_name),
    "q_number_shape": _column(_SHAPE, repair.looks_like_number),
    "q_number_terms": _column(_PARTS, lambda c: F.array_join(analysis.number_terms(c), " ")),
}

_U = f"WITH x AS (SELECT page_id, page_id % 12 AS k, CAST(page_id AS VARCHAR) AS i, {_URL.format(i='CAST(page_id AS VARCHAR)', s='VARCHAR')} AS u FROM pages WHERE page_id % 12 <> 0) "
_MONTHS = ", ".join(f"'{m}'" for m in text.MONTHS_GENITIVE)
_LETTERS = "А-Яа-яЁёA-Za-z"
_KIND = "CASE k WHEN 1 THEN 'news' WHEN 2 THEN 'announcement'"
_PATH = r"regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(u, '\?(.*)$', 1)"
_SQUEEZE = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
ORACLE = {
    "q_docnum": _sql(_NUMBER, "CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 6 = 5 THEN '-фз' WHEN doc_id % 6 = 1 THEN '-р' ELSE '-р' END AS want"),
    "q_hyphen": _sql(_BROKEN, f"sha256(replace(regexp_replace(replace(v, '-\n  th', chr(1) || 'th'), '([{_LETTERS}]{{2,}})' || chr(1), '\\1', 'g'), chr(1), '-\n  ')) AS want"),
    "q_repair": _sql(_MIXED, "sha256('Сочи решение ' || coalesce(text, '')) AS want, 2 AS mixed"),
    "q_techname": _sql(_NAME, "doc_id % 3 = 0 AS want"),
    "q_number_shape": _sql(_SHAPE, "doc_id % 3 = 0 AS want"),
    "q_csv_guard": _sql(_GUARDED, "sha256(CASE WHEN doc_id % 5 < 4 THEN '''' ELSE '' END || v) AS want"),
    "q_number_terms": _sql(_PARTS, "CAST(doc_id AS VARCHAR) || ' р ' || CAST(doc_id AS VARCHAR) || 'р ' || regexp_replace(source, '^([a-z]+)([0-9]+)$', '\\1 \\2 \\1\\2') AS want"),
    "q_legal": _sql(_ACT, "CASE doc_id % 4 WHEN 0 THEN 'Постановление' WHEN 1 THEN 'Распоряжение' WHEN 2 THEN 'Приказ' END AS kind, CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS VARCHAR) || '-р' WHEN 1 THEN CAST(doc_id AS VARCHAR) WHEN 2 THEN '7' END AS number, CASE doc_id % 4 WHEN 0 THEN '2024-03-14' WHEN 1 THEN '2023-06-02' END AS date, doc_id % 4 < 2 AS reliable, doc_id % 4 = 2 AS needs_ocr"),
    "q_labelled": _sql(_LABEL, "CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS VARCHAR) || '-р' WHEN 1 THEN CAST(doc_id AS VARCHAR) END AS want"),
    "q_scoring_form": _sql(_SCORED, "sha256(" + _SQUEEZE.format(x="translate(v, '«»“”„‐‑‒–—−', '\"\"\"\"\"------')") + ") AS want"),
    "q_strip_tags": "SELECT page_id, sha256(" + _SQUEEZE.format(x="replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')") + ") AS want FROM pages",
    "q_query_words": "WITH x AS (SELECT doc_id, regexp_extract_all('где найти ' || coalesce(text, ''), '[0-9A-Za-zА-Яа-яЁё№/-]+') AS w, 'где найти ' || coalesce(text, '') AS v FROM documents) SELECT doc_id, len(w) AS words, sha256(CASE WHEN len(w) - 2 >= 2 THEN array_to_string(w[3:], ' ') ELSE trim(v, ' ') END) AS want FROM x",
    "q_titles": "WITH x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Файл' WHEN 1 THEN 'Скачать документ ' || CAST(doc_id AS VARCHAR) WHEN 2 THEN 'Скачать документ: Приказ' ELSE 'Отчёт ' || CAST(doc_id AS VARCHAR) END AS v FROM documents) SELECT doc_id, doc_id % 4 < 2 AS generic, CASE WHEN doc_id % 4 = 2 THEN 'Приказ' ELSE 'шум ' || v END AS title, CASE WHEN doc_id % 2 = 0 THEN v ELSE 'rest' END AS first, CAST(NULL AS VARCHAR) AS none FROM x",
    "q_date_display": f"SELECT o_orderkey, CAST(day(o_orderdate) AS VARCHAR) || ' ' || [{_MONTHS}][month(o_orderdate)] || ' ' || CAST(year(o_orderdate) AS VARCHAR) AS want FROM orders",
    "q_url_class": _U + f"SELECT page_id, CASE WHEN k = 4 THEN 'pdf' WHEN k = 1 THEN 'novosti' WHEN k = 2 THEN 'obyavleniya' WHEN k IN (7, 10) OR (k = 8 AND page_id >= 10000) THEN 'drugaya-kartochka' ELSE 'razdel-ili-stranitsa' END AS kind, k = 5 AS paged, CASE WHEN k = 5 THEN page_id END AS page, coalesce(list_max([CAST(n AS BIGINT) FOR n IN regexp_extract_all({_PATH}, '\\d+')]), 0) AS newest, CASE k WHEN 4 THEN 'pdf' WHEN 6 THEN 'archive' WHEN 11 THEN 'office' ELSE 'html' END AS format, k IN (1, 2, 7, 10) OR (k = 8 AND page_id >= 10000) AS detail FROM x",
    "q_category": _U + f"SELECT page_id, {_KIND} WHEN 4 THEN 'file' WHEN 6 THEN 'file' WHEN 7 THEN 'legal' WHEN 9 THEN 'city' ELSE 'page' END AS crawl, {_KIND} WHEN 3 THEN 'legacy' WHEN 4 THEN 'file' WHEN 6 THEN 'file' WHEN 7 THEN 'legal' WHEN 9 THEN 'city' ELSE 'page' END AS display, {_KIND} WHEN 3 THEN 'legacy' WHEN 4 THEN 'file' WHEN 6 THEN 'file' WHEN 7 THEN 'legal' WHEN 9 THEN 'city' ELSE 'other' END AS reindex FROM x",
    "q_url_checks": _U + f"SELECT page_id, CASE k WHEN 3 THEN 'неверная схема' WHEN 8 THEN 'чужой хост' WHEN 5 THEN 'пагинация попала в кандидаты' END AS odd, {_KIND} END AS kind, 'https://city.example' || CASE WHEN k = 9 THEN '/gorod/obshchaya-informatsiya/gorod-sobytiye/' ELSE {_PATH} END || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END AS request, replace(u, 'https:', 'http:') AS attachment, k = 6 AS archive, k = 11 AS old_office, k = 3 AS legacy, true AS allowed FROM x",
    "q_request_url": _U + "SELECT page_id, CASE WHEN page_id % 2 = 0 AND page_id % 5 <> 0 THEN 'f' WHEN page_id % 3 <> 0 THEN u WHEN page_id % 5 <> 0 THEN 'f' ELSE 'p' END AS url, page_id % 4 = 0 OR k = 4 AS pdf, CASE WHEN page_id % 4 = 0 THEN 'application/pdf' ELSE '' END AS content_type FROM x",
    "q_candidates": _U + "SELECT CASE WHEN page_id % 2 = 0 OR k = 9 AND EXISTS (SELECT 1 FROM x AS y WHERE y.k = 9 AND y.page_id % 2 = 0) THEN 'html' ELSE 'sitemap' END AS source, count(DISTINCT u) AS n FROM x GROUP BY 1",
    "q_describe": _U + "SELECT u AS url, CASE k WHEN 4 THEN 'pdf' ELSE 'page' END AS doc_type, CASE WHEN k <> 4 THEN u END AS page_url, CASE WHEN k = 4 THEN u END AS file_url, CASE WHEN k = 4 THEN 'application/pdf' END AS content_type FROM x",
    "q_reconcile": "WITH q AS (SELECT o_orderkey AS k, ['pending', 'done', 'not_indexed', 'skipped'][o_orderkey % 4 + 1] AS status, o_orderkey % 6 AS attempts FROM orders), s AS (SELECT *, CASE WHEN k % 3 <> 0 THEN ['indexed', 'gone', 'unchanged', 'discovered', 'quarantined'][k % 5 + 1] END AS st, CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END AS act FROM q), "
    "f AS (SELECT *, st IS NOT NULL AND (st IN ('gone', 'quarantined') OR act = 0) AS ended, st IN ('indexed', 'unchanged') AND act = 1 AND status = 'not_indexed' AS again FROM s) SELECT CAST(k AS VARCHAR) AS url, CASE WHEN ended AND status NOT IN ('done', 'skipped') THEN 'skipped' WHEN again THEN 'pending' ELSE status END AS status, CASE WHEN again AND NOT ended THEN 0 ELSE attempts END AS attempts FROM f",
    "q_inherit": "WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS n, o_orderpriority AS p FROM orders) SELECT CAST(s.k AS VARCHAR) AS url, CASE WHEN s.k % 3 <> 0 THEN coalesce(f.n, s.n) ELSE s.n END AS document_number, CAST(NULL AS VARCHAR) AS document_date, CASE WHEN s.k % 3 <> 0 THEN coalesce(f.p, s.p) ELSE s.p END AS document_kind FROM s LEFT JOIN s AS f ON f.k = s.k - 1",
}
