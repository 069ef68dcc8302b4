"""Catalogue queries over URL, queue, report and chunk operators, with their oracle SQL.

`orders` stands in for the crawl queue, `customer` for upserts, `lineitem` for
recognised words; rules for which the tables have no values run on literal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions import legal, metrics, urls
from quarrylight.functions.text import compact
from quarrylight.operators import chunking, reports, state


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rows(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _sql_rows(columns: str, *rows: tuple) -> str:
    """The same literal rows in SQL."""
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") AS t({columns})"


# ---- URLs of pages -------------------------------------------------------------


def q_url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"))


def q_url_dedupe(spark: SparkSession, d: str) -> DataFrame:
    keyed = _t(spark, d, "pages").withColumn("k", urls.dedupe_key(F.col("url")))
    return keyed.groupBy("k").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n")).select("k.path", "k.query", "page_id", "n")


def q_url_class(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _rows(spark, "id int, url string", *URLS).select("id", urls.url_class(u).alias("kind"), urls.is_pagination(u).alias("paged"), urls.newest_number(u).alias("newest"), urls.format_bucket(u, F.lit(None)).alias("format"))


def q_category(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _rows(spark, "id int, url string", *URLS).select("id", urls.crawl_category(u).alias("crawl"), urls.display_category(u).alias("display"), urls.reindex_category(u).alias("reindex"))


def q_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, "id int, url string", *CANONICAL).select("id", urls.canonical_sitemap_url(F.col("url"), "city.example").alias("url"))


def q_canonical_html(spark: SparkSession, d: str) -> DataFrame:
    links = _rows(spark, "id int, url string", *LINKS)
    return links.select("id", urls.canonical_html_url("city.example")(F.col("url"), F.lit("https://city.example/gorod/a/")).alias("url"))


def q_html_title(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", compact(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


def q_html_text(spark: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    return _t(spark, d, "pages").select("page_id", F.length(compact(bare)).cast("long").alias("n"))


def q_links(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r"href=[\"']([^\"'#]+)"), 1)
    return _t(spark, d, "pages").select("page_id", F.explode(found).alias("link")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("link").alias("different"))


URLS = [
    (1, "https://city.example/press-sluzhba/novosti/12/345"), (2, "https://city.example/press-sluzhba/obyavleniya/77/"), (3, "https://city.example/upload/iblock/act.pdf"), (4, "https://city.example/a/antikor-ekspert/9"),
    (5, "https://city.example/gorodskaya-vlast/normativno-pravovyye-akty/?ELEMENT_ID=5"), (6, "https://city.example/gorodskaya-vlast/normativno-pravovyye-akty/"), (7, "https://city.example/gorod/10000"), (8, "https://city.example/gorod/9999"),
    (9, "https://city.example/press-sluzhba/mediagalereya/x.php?PAGEN_1=3"), (10, "https://city.example/content/detail.php?id=1"), (11, "https://city.example/afisha-goroda/a.html"), (12, "https://city.example/files/table.xlsx"),
    (13, "https://city.example"), (14, "https://city.example/x/archive.zip"), (15, "https://city.example/zhizn-goroda/"), (16, None),
]
_CLASSES = [
    (1, "novosti", True, 345, "html", "news", "news", "news"), (2, "obyavleniya", True, 77, "html", "announcement", "announcement", "announcement"), (3, "pdf", True, 0, "pdf", "file", "file", "file"), (4, "antikor-ekspert", True, 9, "html", "page", "page", "other"),
    (5, "drugaya-kartochka", True, 0, "html", "legal", "legal", "legal"), (6, "razdel-ili-stranitsa", True, 0, "html", "city_authority", "legal", "legal"), (7, "drugaya-kartochka", True, 10000, "html", "city", "city", "city"), (8, "razdel-ili-stranitsa", True, 9999, "html", "city", "city", "city"),
    (9, "razdel-ili-stranitsa", False, 0, "html", "media", "media", "media"), (10, "razdel-ili-stranitsa", True, 0, "html", "page", "legacy", "legacy"), (11, "razdel-ili-stranitsa", True, 0, "html", "events", "events", "events"), (12, "razdel-ili-stranitsa", True, 0, "office", "page", "page", "other"),
    (13, "razdel-ili-stranitsa", True, 0, "other", "page", "page", "other"), (14, "razdel-ili-stranitsa", True, 0, "archive", "page", "page", "other"), (15, "razdel-ili-stranitsa", True, 0, "html", "city_life", "city_life", "city_life"), (16, "razdel-ili-stranitsa", True, 0, "html", "page", "page", None),
]
CANONICAL = [
    (1, "http://www.city.example//a//b/?utm_source=x&b=2&a=1&gclid=3#top"), (2, "https://CITY.example/a/file.PDF"), (3, "ftp://city.example/a"), (4, "https://other.example/a"), (5, "https://city.example/bitrix/x"), (6, "https://city.example/pic.png"),
    (7, "https://city.example/content/detail.php?ID=4"), (8, "https://m.city.example/x?y="), (9, "https://city.example"),
]
_CANONICAL = [(1, "https://city.example/a/b/?a=1&b=2"), (2, "https://city.example/a/file.PDF"), (3, None), (4, None), (5, None), (6, None), (7, None), (8, "https://m.city.example/x?y="), (9, "https://city.example/")]
LINKS = [(1, "../b/./c.html?year=2024&utm_x=1"), (2, "#top"), (3, "mailto:a@b"), (4, "/press-sluzhba/novosti/1/2?PAGEN_1=4"), (5, "/list/?PAGEN_1=4&x=1"), (6, "https://www.city.example/act.docx"), (7, "/pic.jpg"), (8, "//other.example/a"), (9, "/local/x"), (10, "")]
_LINKS = [(1, "https://city.example/gorod/b/c.html?year=2024"), (2, None), (3, None), (4, "https://city.example/press-sluzhba/novosti/1/2"), (5, "https://city.example/list/?PAGEN_1=4"), (6, "https://city.example/act.docx"), (7, None), (8, None), (9, None), (10, None)]

# ---- the queue -----------------------------------------------------------------

_QUEUE_SCHEMA = "url string, page_url string, file_url string, doc_type string, status string, is_active int, next_check_at string, last_checked_at string, extraction_version string, indexed_chunks int"


def _orders_queue(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a queue: status and type by priority and status, a date as the next check."""
    o = _t(spark, d, "orders")
    status = F.element_at(F.array(*[F.lit(s) for s in (*state.QUEUE_ORDER, "gone")]), (F.col("o_custkey") % 8 + 1).cast("int"))
    kind = F.when(F.col("o_orderstatus") == "O", "page").when(F.col("o_orderstatus") == "F", "pdf").otherwise("file")
    due = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    null = F.lit(None).cast("string")
    return o.select(F.col("o_orderkey").cast("string").alias("url"), null.alias("page_url"), null.alias("file_url"), kind.alias("doc_type"), status.alias("status"), F.when(F.col("o_orderkey") % 11 == 0, 0).otherwise(1).alias("is_active"), due.alias("next_check_at"), null.alias("last_checked_at"), null.alias("extraction_version"), F.lit(0).alias("indexed_chunks"))


def q_queue_order(spark: SparkSession, d: str) -> DataFrame:
    rows = state.candidates(_orders_queue(spark, d), now="1995-06-30").orderBy(*state.queue_order()).limit(500)
    return rows.select("url", F.col("status_rank").cast("long").alias("status_rank"), F.col("turn").cast("long").alias("turn"), F.col("type_rank").cast("long").alias("type_rank"))


_QUEUE = """
WITH q AS (SELECT CAST(o_orderkey AS VARCHAR) AS url, ['discovered', 'indexed_existing', 'retry', 'missing', 'indexed', 'unchanged', 'skipped_empty', 'gone'][o_custkey % 8 + 1] AS status,
  CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS type_rank, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS due FROM orders WHERE o_orderkey % 11 <> 0),
r AS (SELECT *, o_custkey_rank AS status_rank FROM (SELECT *, CAST(list_position(['discovered', 'indexed_existing', 'retry', 'missing', 'indexed', 'unchanged', 'skipped_empty', 'gone'], status) - 1 AS BIGINT) AS o_custkey_rank FROM q) WHERE due IS NULL OR due <= '1995-06-30'),
n AS (SELECT *, row_number() OVER (PARTITION BY status, type_rank ORDER BY coalesce(due, ''), url) AS turn FROM r)
SELECT url, status_rank, turn, CAST(type_rank AS BIGINT) AS type_rank FROM n ORDER BY status_rank, turn, type_rank, coalesce(due, ''), url LIMIT 500
"""


def _interleaved(spark: SparkSession) -> DataFrame:
    kinds = ["page", "page", "page", "pdf", "pdf", "file", "file"]
    rows = [(f"https://h/{k}-{i}", None, None, k, "discovered", 1, "ready", None, None, 0) for i, k in enumerate(kinds)]
    return _rows(spark, _QUEUE_SCHEMA, *rows)


def q_queue_interleave(spark: SparkSession, d: str) -> DataFrame:
    rows = state.candidates(_interleaved(spark), now="x", force=True).orderBy(*state.queue_order()).limit(6)
    return rows.select("doc_type", F.col("turn").cast("long").alias("turn"))


def q_parent(spark: SparkSession, d: str) -> DataFrame:
    parents = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("url"), F.col("c_name").alias("document_number"), F.lit(None).cast("string").alias("document_date"), F.col("c_mktsegment").alias("document_kind"))
    children = _t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") + 1000).cast("string").alias("parent_url"))
    return state.with_parents(children, parents).select("o_orderkey", "parent_document_number", "parent_document_kind")


_CHILDREN = [("p", None, "page", "620-р", "2012-11-30", "Распоряжение"), ("a", "p", "pdf", "122", "2012-12-02", None), ("b", "p", "file", None, None, None), ("c", "x", "pdf", "7", None, "Приказ"), ("e", "p", "page", "9", None, None)]
_CHILD_COLUMNS = "url, parent_url, doc_type, document_number, document_date, document_kind"


def q_inherit(spark: SparkSession, d: str) -> DataFrame:
    return state.inherit(_rows(spark, ", ".join(f"{c} string" for c in _CHILD_COLUMNS.split(", ")), *_CHILDREN)).select("url", "document_number", "document_date", "document_kind")


def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"), "c_acctbal")
    new = c.where("c_custkey % 4 <> 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), F.when(F.col("c_custkey") % 5 == 0, F.lower("c_mktsegment")).alias("segment"), (-F.col("c_acctbal")).alias("c_acctbal"))
    return state.upsert(old, new, "c_custkey", keep_old=("c_name",), replace=("c_acctbal",))


def q_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select("c_custkey", "c_name")
    return state.insert_new(c.where("c_custkey % 2 = 0"), c.select("c_custkey", F.lower("c_name").alias("c_name")), "c_custkey")


def q_known(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


_PUBLICATION = [("a", "pending", 1), ("b", "not_indexed", 3), ("c", "done", 0), ("e", "retry", 2), ("f", "not_indexed", 4)]
_CRAWLED = [("a", "gone", 0), ("b", "indexed", 1), ("c", "gone", 0), ("f", "skipped_corrupt", 0)]


def q_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return state.reconcile(_rows(spark, "url string, status string, attempts int", *_PUBLICATION), _rows(spark, "url string, status string, is_active int", *_CRAWLED)).select("url", "status", "attempts")


_EVENTS = ["not_modified", "same_source", "same_content", "indexed", "not_found", "http_error", "error", "skipped_empty", "skipped_corrupt", "skipped_unsupported", "skipped_too_large"]


def q_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Every order is a URL; its event follows from its key."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("url"), F.lit("processing").alias("status"), (F.col("o_custkey") % 6).cast("int").alias("failure_count"), (F.col("o_custkey") % 4).cast("int").alias("consecutive_missing"), F.lit(2).alias("attempt_count"), F.lit(1).alias("is_active"), F.lit("old").alias("next_check_at"))
    events = _t(spark, d, "orders").where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("url"), F.element_at(F.array(*[F.lit(e) for e in _EVENTS]), (F.col("o_orderkey") % 11 + 1).cast("int")).alias("event"))
    return state.transition(o, events, recheck="recheck", retry="retry", missing="missing")


_TRANSITIONS = f"""
WITH o AS (SELECT o_orderkey AS url, o_custkey % 6 AS f, o_custkey % 4 AS m, CASE WHEN o_orderkey % 13 <> 0 THEN {_EVENTS}[o_orderkey % 11 + 1] END AS e FROM orders)
SELECT url, CASE WHEN e IS NULL THEN 'processing' WHEN e IN ('not_modified', 'same_source', 'same_content') THEN 'unchanged' WHEN e = 'indexed' THEN 'indexed' WHEN e = 'not_found' THEN CASE WHEN m + 1 >= 3 THEN 'gone' ELSE 'missing' END WHEN e = 'http_error' THEN CASE WHEN f + 1 >= 5 THEN 'quarantined' ELSE 'retry' END WHEN e = 'error' THEN 'retry' ELSE e END AS status,
  CAST(CASE WHEN e IS NULL THEN f WHEN e IN ('not_found', 'http_error', 'error') THEN f + 1 ELSE 0 END AS INTEGER) AS failure_count,
  CAST(CASE WHEN e = 'not_found' THEN m + 1 WHEN e IN ('not_modified', 'same_source', 'same_content', 'indexed') THEN 0 ELSE m END AS INTEGER) AS consecutive_missing,
  CASE WHEN e IS NULL THEN 2 ELSE 3 END AS attempt_count,
  CASE WHEN e = 'not_found' AND m + 1 >= 3 OR e = 'http_error' AND f + 1 >= 5 OR e IN ('skipped_corrupt', 'skipped_unsupported', 'skipped_too_large') THEN 0 ELSE 1 END AS is_active,
  CASE WHEN e IS NULL THEN 'old' WHEN e = 'http_error' AND f + 1 >= 5 OR e IN ('skipped_corrupt', 'skipped_unsupported', 'skipped_too_large') THEN NULL WHEN e = 'not_found' THEN 'missing' WHEN e IN ('http_error', 'error') THEN 'retry' ELSE 'recheck' END AS next_check_at FROM o
"""


def q_lease(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("url"), F.when(F.col("o_orderstatus") == "O", "processing").otherwise("indexed").alias("status"), F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("locked_at"), (F.col("o_custkey") % 4).cast("string").alias("locked_by"), F.lit("later").alias("next_check_at"))
    alive = _rows(spark, "locked_by string", ("0",), ("1",), ("2",))
    return state.release_stale(o, before="1997-01-01", now="now", workers=alive)


def q_requeue(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("url"), F.lower("o_orderstatus").alias("doc_type"), F.lit("indexed").alias("status"), F.lit(1).alias("is_active"), F.lit(None).cast("string").alias("document_number"), F.when(F.col("o_orderkey") % 50 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("last_indexed_at"), F.lit("hash").alias("content_hash"), F.lit("later").alias("next_check_at"))
    return state.requeue(o, now="now", doc_types=("o", "f"), like="%1%", limit=1000).select("url", "content_hash", "next_check_at")


def q_replace_rows(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select("c_custkey", "c_name")
    return state.replace_rows(c, c.where("c_custkey % 10 = 0").withColumn("c_name", F.lit("again")), "c_custkey")


def q_delete_stale(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("url"), "l_linenumber", F.col("l_returnflag").alias("hash"))
    current = _t(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("url"), F.lit("N").alias("hash"))
    return state.delete_stale(lines, current)


# ---- reports -------------------------------------------------------------------


def q_formats(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders_queue(spark, d).withColumn("last_indexed_at", F.col("next_check_at"))
    long = ("total", "loaded", "remaining", "processing", "terminal", "problems")
    return reports.pipeline_status(rows).select(F.coalesce("format", F.lit("all")).alias("format"), *[F.col(c).cast("long").alias(c) for c in long], "percent", "last_indexed_at")


_FORMATS = """
WITH q AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'html' WHEN 'F' THEN 'pdf' ELSE 'html' END AS format, ['discovered', 'indexed_existing', 'retry', 'missing', 'indexed', 'unchanged', 'skipped_empty', 'gone'][o_custkey % 8 + 1] AS s,
  o_orderkey % 11 = 0 AS off, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS due FROM orders),
f AS (SELECT format, due, s = 'gone' OR off AS t, s IN ('indexed', 'indexed_existing', 'unchanged') AND NOT (s = 'gone' OR off) AS l, s IN ('missing', 'retry') AS b FROM q)
SELECT coalesce(format, 'all') AS format, count(*) AS total, count(*) FILTER (l) AS loaded, count(*) FILTER (NOT l AND NOT t) AS remaining, CAST(0 AS BIGINT) AS processing, count(*) FILTER (t) AS terminal, count(*) FILTER (b) AS problems,
  round_even(100 * count(*) FILTER (l) / (count(*) - count(*) FILTER (t)), 1) AS percent, max(due) AS last_indexed_at FROM f GROUP BY ROLLUP (format)
"""


def q_status(spark: SparkSession, d: str) -> DataFrame:
    return reports.status_counts(_t(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"))


def q_queue_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select(F.when(F.col("o_orderpriority") == "5-LOW", "processing").otherwise(F.col("o_orderstatus")).alias("status"))
    return reports.queue_summary(rows, ("F",), ("O",), ("P",))


def q_statistics(spark: SparkSession, d: str) -> DataFrame:
    return reports.statistics(_t(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("is_active"))).select("total", F.col("active").cast("long").alias("active"))


def q_samples(spark: SparkSession, d: str) -> DataFrame:
    return reports.samples(_t(spark, d, "part").select("p_type", "p_partkey"), "p_type", ["p_partkey"], 3)


def q_latest_run(spark: SparkSession, d: str) -> DataFrame:
    return reports.latest_run(_t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice"))


def q_confidence(spark: SparkSession, d: str) -> DataFrame:
    words = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_quantity") * 2 - 5).alias("conf"), F.when(F.col("l_linenumber") == 3, " ").otherwise(F.col("l_returnflag")).alias("text"))
    return reports.confidence(words, "page").select("page", F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), "words")


def q_document_confidence(spark: SparkSession, d: str) -> DataFrame:
    pages = _t(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(0.0).alias("confidence"))
    return reports.document_confidence(pages, "l_orderkey")


def q_ladder(spark: SparkSession, d: str) -> DataFrame:
    step = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey"))
    attempts = _t(spark, d, "lineitem").select("l_orderkey", step.alias("step"), (F.col("l_quantity") + 20).alias("confidence"))
    return reports.best_attempt(attempts, "l_orderkey")


def q_cer(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item against the next one; the oracle's distance counts bytes, so letters beyond ASCII become one."""
    b = _t(spark, d, "benchmark").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("found"))
    return b.join(after, "item_id").select("item_id", F.round(metrics.character_error_rate(F.col("text"), F.col("found")), 9).alias("cer"))


def q_wer(spark: SparkSession, d: str) -> DataFrame:
    b = _t(spark, d, "benchmark")
    return b.select("item_id", metrics.word_error_rate(F.col("text"), F.concat(F.lit("one more "), F.col("text"))).alias("wer"))


def q_manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    now = docs.where("path % 7 <> 0").withColumn("sha256", F.when(F.col("path") % 5 == 0, F.lit("other")).otherwise(F.col("sha256")))
    return reports.manifest_differences(docs.where("path % 3 <> 0"), now)


def q_expired(spark: SparkSession, d: str) -> DataFrame:
    return reports.expired(_t(spark, d, "nation").select(F.col("n_name").alias("name")), 7)


# ---- hashes and chunks ---------------------------------------------------------


def q_hash(spark: SparkSession, d: str) -> DataFrame:
    null = F.lit(None).cast("string")
    pages = F.array(F.struct(F.lit(1).alias("page_number"), F.col("text").alias("text")))
    links = F.array().cast("array<struct<url:string,title:string>>")
    h = chunking.content_hash(F.col("source"), F.col("lang"), null, null, null, null, null, null, links, pages)
    return _t(spark, d, "documents").select("doc_id", h.alias("hash"), chunking.chunk_id(F.col("source"), F.lit(1), F.col("doc_id")).alias("chunk_id"))


def q_exact_dups(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))


def q_chunk(spark: SparkSession, d: str) -> DataFrame:
    pages = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("url"), F.lit(1).alias("page_number"), "text")
    return chunking.chunks(pages, 1000, 100).select("url", F.col("chunk_number").cast("long").alias("chunk_number"), F.sha2("text", 256).alias("piece"))


_CHUNK = r"""
WITH RECURSIVE t AS (SELECT CAST(doc_id AS VARCHAR) AS url, array_to_string([x FOR x IN [trim(regexp_replace(y, '[ \t]+', ' ', 'g')) FOR y IN string_split(text, chr(10))] IF x <> ''], chr(10)) AS s FROM documents),
c AS (SELECT url, s, 0 AS a, 0 AS n, 0 AS b FROM t WHERE s <> '' UNION ALL
  SELECT url, s, a2, n + 1, e FROM (SELECT *, CASE WHEN n = 0 THEN 0 ELSE greatest(b - 100, a + 1) END AS a2 FROM c WHERE n = 0 OR b < length(s)) AS w,
  LATERAL (SELECT CASE WHEN a2 + 1000 >= length(s) THEN length(s) ELSE coalesce((SELECT max(p + len(sep)) FROM (SELECT sep, lo + length(z) - length(sep) - (strpos(reverse(z), reverse(sep)) - 1) AS p FROM (SELECT least(a2 + 500, length(s)) AS lo, s[least(a2 + 500, length(s)) + 1 : a2 + 1000] AS z), (VALUES ('. '), ('! '), ('? '), ('; '), (chr(10))) AS v(sep) WHERE contains(z, sep))), a2 + 1000) END AS e) AS x)
SELECT url, row_number() OVER (PARTITION BY url ORDER BY n) AS chunk_number, sha256(trim(s[a + 1 : b], ' ' || chr(10))) AS piece FROM c WHERE n > 0 AND trim(s[a + 1 : b], ' ' || chr(10)) <> ''
"""

# ---- acts ----------------------------------------------------------------------

_ACTS = [(1, "Постановление администрации от 14.03.2024 № 512-р о благоустройстве"), (2, "РАСПОРЯЖЕНИЕ от 2 июня 2023 года N 84-рс"), (3, "Просто текст"), (4, "Приказ от 30.02.2024 № 7"), (5, "Указ без номера"), (6, None)]
_ACT_WANT = [(1, "Постановление", "512-р", "2024-03-14"), (2, "Распоряжение", "84-рс", "2023-06-02"), (3, None, None, None), (4, "Приказ", "7", None), (5, "Указ", None, None), (6, None, None, None)]
_LABELS = [(1, "Номер документа: 512-р"), (2, "номер документа\n 620-р \nДата документа"), (3, "Номер документа\nДата документа"), (4, "иное"), (5, "Номер документа:")]


def q_legal(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, "id int, v string", *_ACTS).select("id", legal.title_metadata(F.col("v")).alias("m")).select("id", "m.kind", "m.number", "m.date")


def q_labelled(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, "id int, v string", *_LABELS).select("id", legal.labelled_value(F.col("v"), "Номер документа").alias("value"))


_ODD = [(1, "https://city.example/a"), (2, "http://city.example/a"), (3, "https://m.city.example/a"), (4, "https://city.example/a/../b"), (5, "https://city.example/https:/x"), (6, "https://city.example/list?page=2"), (7, "https://city.example/press-sluzhba/novosti/1/2/"), (8, "https://www.city.example/press-sluzhba/"), (9, "ftp://city.example/x")]
_ODD_WANT = [(1, None, None, "https://city.example/a", "http://city.example/a"), (2, "неверная схема", None, "https://city.example/a", "http://city.example/a"), (3, "чужой хост", None, "https://city.example/a", "http://m.city.example/a"), (4, "служебный или ненормализованный путь", None, "https://city.example/a/../b", "http://city.example/a/../b"), (5, "вложенная схема в пути", None, "https://city.example/https:/x", "http://city.example/https:/x"), (6, "пагинация попала в кандидаты", None, "https://city.example/list?page=2", "http://city.example/list?page=2"), (7, None, "news", "https://city.example/press-sluzhba/novosti/1/2/", "http://city.example/press-sluzhba/novosti/1/2/"), (8, "чужой хост", None, "https://city.example/press-sluzhba/novosti/", "http://city.example/press-sluzhba/"), (9, "неверная схема", None, "https://city.example/x", None)]


def q_url_checks(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _rows(spark, "id int, url string", *_ODD).select("id", urls.suspicious(u, "city.example").alias("odd"), urls.publication_kind(u).alias("kind"), urls.fetch_url(u, "city.example").alias("request"), urls.attachment_url(u, "city.example").alias("attachment"))


def q_publish_dates(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("url"), "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") % 3 == 0, F.lit("act")).when(F.col("l_linenumber") % 3 == 1, F.lit("")).alias("document_date"), F.lit("old").alias("sort_date"), F.lit(None).cast("string").alias("published_at"))
    dates = _t(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("url"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_at"))
    return state.publish_dates(lines, dates)


def q_reset_status(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("url"), F.col("o_orderstatus").alias("status"), F.lit(4).alias("attempts"), F.lit("e").alias("last_error"))
    return state.reset_status(rows, "F", now="now")


def q_page_decision(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") < 10).alias("blank"), (F.col("l_partkey") % 2 == 0).alias("native"), F.when(F.col("l_suppkey") % 3 != 0, "x").alias("text"), (F.col("l_suppkey") % 2 == 0).alias("good"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", reports.page_decision(F.col("blank"), F.col("native"), F.col("text"), F.col("good")).alias("method"))


def q_best_rotation(spark: SparkSession, d: str) -> DataFrame:
    step = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey"))
    attempts = _t(spark, d, "lineitem").select("l_orderkey", step.alias("step"), (F.col("l_quantity") > 25).alias("acceptable"), (F.col("l_quantity") + 40).alias("score"), "l_suppkey").withColumnRenamed("l_suppkey", "length")
    return reports.best_rotation(attempts, "l_orderkey")


def q_bfs(spark: SparkSession, d: str) -> DataFrame:
    from quarrylight.operators.discovery import reachable

    n = _t(spark, d, "nation")
    edges = n.select(F.col("n_nationkey").cast("string").alias("src"), ((F.col("n_nationkey") * 2 + 1) % 25).cast("string").alias("dst")).unionByName(n.select(F.col("n_nationkey").cast("string").alias("src"), (F.col("n_nationkey") + 100).cast("string").alias("dst")))
    return reachable(_rows(spark, "url string", ("0",)), edges, depth=4).select("url", F.col("depth").cast("long").alias("depth"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLE = {
    "q_url_parts": r"SELECT page_id, lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages",
    "q_url_dedupe": r"WITH k AS (SELECT page_id, lower(CASE WHEN rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') END) AS path, lower(regexp_extract(url, '^[^?#]*\?([^#]*)', 1)) AS query FROM pages) SELECT path, query, min(page_id) AS page_id, count(*) AS n FROM k GROUP BY ALL",
    "q_url_class": "SELECT id, kind, NOT unpaged AS paged, CAST(newest AS BIGINT) AS newest, format FROM " + _sql_rows("id, kind, unpaged, newest, format", *[r[:5] for r in _CLASSES]),
    "q_category": "SELECT * FROM " + _sql_rows("id, crawl, display, reindex", *[(r[0], *r[5:]) for r in _CLASSES]),
    "q_canonical": "SELECT * FROM " + _sql_rows("id, url", *_CANONICAL),
    "q_canonical_html": "SELECT * FROM " + _sql_rows("id, url", *_LINKS),
    "q_html_title": r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages",
    "q_html_text": r"SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS n FROM pages",
    "q_links": "SELECT page_id, count(*) AS n, count(DISTINCT link) AS different FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=[\"'']([^\"''#]+)', 1)) AS link FROM pages) GROUP BY 1",
    "q_queue_order": _QUEUE,
    "q_queue_interleave": "SELECT kind AS doc_type, CAST(turn AS BIGINT) AS turn FROM " + _sql_rows("kind, turn", ("page", 1), ("pdf", 1), ("file", 1), ("page", 2), ("pdf", 2), ("file", 2)),
    "q_parent": "SELECT o_orderkey, c_name AS parent_document_number, c_mktsegment AS parent_document_kind FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 1000",
    "q_inherit": "WITH t AS (SELECT * FROM " + _sql_rows(_CHILD_COLUMNS, *_CHILDREN) + ") SELECT c.url, " + ", ".join(f"CASE WHEN c.doc_type IN ('pdf', 'file') THEN coalesce(p.{x}, c.{x}) ELSE c.{x} END AS {x}" for x in ("document_number", "document_date", "document_kind")) + " FROM t AS c LEFT JOIN t AS p ON c.parent_url = p.url",
    "q_upsert": "WITH o AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, 'new ' || c_name AS c_name, CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) END AS segment, -c_acctbal AS c_acctbal FROM customer WHERE c_custkey % 4 <> 0) SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.c_name, n.c_name) AS c_name, coalesce(n.segment, o.segment) AS segment, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal ELSE o.c_acctbal END AS c_acctbal FROM o FULL JOIN n ON o.c_custkey = n.c_custkey",
    "q_insert_ignore": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE lower(c_name) END AS c_name FROM customer",
    "q_known": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "q_reconcile": "SELECT url, status, CAST(attempts AS INTEGER) AS attempts FROM " + _sql_rows("url, status, attempts", ("a", "skipped", 1), ("b", "pending", 0), ("c", "done", 0), ("e", "retry", 2), ("f", "skipped", 4)),
    "q_transitions": _TRANSITIONS,
    "q_lease": "WITH o AS (SELECT o_orderkey AS url, CASE WHEN o_orderstatus = 'O' THEN 'processing' ELSE 'indexed' END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS l, CAST(o_custkey % 4 AS VARCHAR) AS w FROM orders), s AS (SELECT *, status = 'processing' AND (l IS NULL OR l < '1997-01-01' OR w = '3') AS stale FROM o) SELECT url, CASE WHEN stale THEN 'retry' ELSE status END AS status, CASE WHEN NOT stale THEN l END AS locked_at, CASE WHEN NOT stale THEN w END AS locked_by, CASE WHEN stale THEN 'now' ELSE 'later' END AS next_check_at FROM s",
    "q_requeue": "WITH c AS (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F') AND CAST(o_orderkey AS VARCHAR) LIKE '%1%' ORDER BY CASE WHEN o_orderkey % 50 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END NULLS FIRST, CAST(o_orderkey AS VARCHAR) LIMIT 1000) SELECT CAST(o.o_orderkey AS VARCHAR) AS url, CASE WHEN c.o_orderkey IS NULL THEN 'hash' END AS content_hash, CASE WHEN c.o_orderkey IS NULL THEN 'later' ELSE 'now' END AS next_check_at FROM orders AS o LEFT JOIN c ON c.o_orderkey = o.o_orderkey",
    "q_replace_rows": "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'again' ELSE c_name END AS c_name FROM customer",
    "q_delete_stale": "SELECT l_orderkey AS url, l_linenumber, l_returnflag AS hash FROM lineitem WHERE NOT (l_returnflag <> 'N' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0))",
    "q_formats": _FORMATS,
    "q_status": "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1",
    "q_queue_summary": "WITH s AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'processing' ELSE o_orderstatus END AS s FROM orders) SELECT count(*) AS total, count(*) FILTER (s = 'F') AS completed, count(*) FILTER (s = 'O') AS pending, count(*) FILTER (s = 'processing') AS processing, count(*) FILTER (s = 'P') AS problems FROM s",
    "q_statistics": "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS active FROM orders",
    "q_samples": "SELECT p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) <= 3",
    "q_latest_run": "SELECT o_orderkey AS id, o_orderstatus, o_totalprice FROM orders ORDER BY 1 DESC LIMIT 1",
    "q_confidence": "SELECT l_orderkey AS page, round(avg(l_quantity * 2 - 5), 6) AS mean, round(avg(CASE WHEN l_quantity * 2 - 5 < 60 THEN 1 ELSE 0 END), 6) AS low, count(*) AS words FROM lineitem WHERE l_quantity * 2 - 5 >= 0 AND l_linenumber <> 3 GROUP BY 1",
    "q_document_confidence": "SELECT l_orderkey, round_even(avg(CASE WHEN l_linenumber % 2 = 0 AND l_quantity > 0 THEN l_quantity END), 2) AS confidence FROM lineitem GROUP BY 1",
    "q_ladder": "WITH s AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey) AS INTEGER) AS step FROM lineitem), a AS (SELECT l_orderkey, step, l_quantity + 20 AS c, coalesce(max(CASE WHEN l_quantity + 20 >= 65 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM s) SELECT l_orderkey, arg_max(step, (c, -step)) AS step, max(c) AS confidence, count(*) AS attempts FROM a WHERE p = 0 GROUP BY 1",
    "q_cer": "WITH b AS (SELECT item_id, trim(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g'), '\\s+', ' ', 'g')) AS t FROM benchmark) SELECT x.item_id, round(least(1.0, CAST(levenshtein(x.t, y.t) AS DOUBLE) / length(x.t)), 9) AS cer FROM b AS x JOIN b AS y ON y.item_id = x.item_id + 1",
    "q_wer": "SELECT item_id, least(1.0, CAST(2.0 AS DOUBLE) / len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '))) AS wer FROM benchmark",
    "q_manifest": "WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 3 <> 0), f AS (SELECT CAST(doc_id AS VARCHAR) AS path, doc_id % 5 = 0 AS bad FROM documents WHERE doc_id % 7 <> 0) SELECT coalesce(m.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'unexpected' ELSE 'mismatch' END AS problem FROM m FULL JOIN f ON m.path = f.path WHERE f.path IS NULL OR m.path IS NULL OR bad",
    "q_expired": "SELECT n_name AS name FROM nation ORDER BY 1 DESC OFFSET 7",
    "q_hash": r"SELECT doc_id, sha256(concat('TITLE:', source, chr(10), 'SECTION:', lang, chr(10), 'CONTENT_CATEGORY:', chr(10), 'SITE_SECTION:', chr(10), 'PUBLISHED_AT:', chr(10), 'DOCUMENT_NUMBER:', chr(10), 'DOCUMENT_DATE:', chr(10), 'DOCUMENT_KIND:', chr(10), chr(12), chr(10), 'PAGE:1', chr(10), text)) AS hash, sha256(source || chr(0) || '1' || chr(0) || CAST(doc_id AS VARCHAR)) AS chunk_id FROM documents",
    "q_exact_dups": "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "q_chunk": _CHUNK,
    "q_legal": "SELECT * FROM " + _sql_rows("id, kind, number, date", *_ACT_WANT),
    "q_labelled": "SELECT * FROM " + _sql_rows("id, value", (1, "512-р"), (2, "620-р"), (3, None), (4, None), (5, None)),
    "q_url_checks": "SELECT * FROM " + _sql_rows("id, odd, kind, request, attachment", *_ODD_WANT),
    "q_publish_dates": "WITH l AS (SELECT l_orderkey AS url, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN 'act' WHEN l_linenumber % 3 = 1 THEN '' END AS document_date FROM lineitem), d AS (SELECT o_orderkey AS url, strftime(o_orderdate, '%Y-%m-%d') AS p FROM orders WHERE o_orderstatus = 'O') SELECT l.url, l_linenumber, l_partkey, document_date, CASE WHEN d.url IS NULL THEN 'old' WHEN document_date = 'act' THEN 'act' ELSE p END AS sort_date, p AS published_at FROM l LEFT JOIN d ON l.url = d.url",
    "q_reset_status": "SELECT o_orderkey AS url, CASE WHEN o_orderstatus = 'F' THEN 'retry' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 4 END AS attempts, CASE WHEN o_orderstatus <> 'F' THEN 'e' END AS last_error FROM orders",
    "q_page_decision": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 10 THEN CASE WHEN l_partkey % 2 = 0 THEN 'native' ELSE 'blank' END WHEN l_suppkey % 3 <> 0 AND l_suppkey % 2 = 0 THEN 'ocr' WHEN l_partkey % 2 = 0 THEN 'native' ELSE 'unreadable' END AS method FROM lineitem",
    "q_best_rotation": "WITH s AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey) AS INTEGER) AS step FROM lineitem), a AS (SELECT *, coalesce(max(CASE WHEN l_quantity + 40 >= 78 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM s) SELECT l_orderkey, arg_max(step, (l_quantity > 25, l_quantity, l_suppkey, -step)) AS step FROM a WHERE p = 0 GROUP BY 1",
    "q_bfs": "WITH RECURSIVE e AS (SELECT n_nationkey AS s, (n_nationkey * 2 + 1) % 25 AS t FROM nation UNION ALL SELECT n_nationkey, n_nationkey + 100 FROM nation), r AS (SELECT 0 AS u, 0 AS depth UNION SELECT t, depth + 1 FROM r JOIN e ON s = u WHERE depth < 4) SELECT CAST(u AS VARCHAR) AS url, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY u",
}
