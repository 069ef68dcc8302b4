"""Catalogue queries over the upkeep of the crawl, with their oracle SQL.

`orders` stands in for the crawl state and the publication queue: a URL is made
of the order's key, so that each kind of URL is there; `lineitem` for pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import reports, upkeep

NOW = "2030-01-01T00:00:00"
_URL = (
    "'https://h' || CASE o_orderkey % 6 WHEN 0 THEN '/press-sluzhba/novosti/1/' || CAST(o_orderkey AS {t}) || '/' WHEN 1 THEN '/press-sluzhba/obyavleniya/' || CAST(o_orderkey AS {t}) "
    "WHEN 2 THEN '/content/detail.php?id=' || CAST(o_orderkey AS {t}) WHEN 3 THEN '/f/' || CAST(o_orderkey AS {t}) || '.zip' WHEN 4 THEN '/f/' || CAST(o_orderkey AS {t}) || '.doc' ELSE '/p/' || CAST(o_orderkey AS {t}) END"
)
_STATE = (
    "{u} AS url, CASE WHEN o_orderkey % 6 IN (3, 4) THEN 'file' ELSE 'page' END AS doc_type, CASE o_orderkey % 7 WHEN 0 THEN 'indexed' WHEN 1 THEN 'gone' WHEN 2 THEN 'processing' WHEN 3 THEN 'quarantined' ELSE 'discovered' END AS status, "
    "CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS is_active, CASE WHEN o_orderkey % 4 = 0 THEN '2029' END AS last_indexed_at, CASE WHEN o_orderkey % 9 = 0 THEN 2 ELSE 0 END AS indexed_chunks, "
    "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS {t}) END AS document_number, o_orderpriority AS document_kind, CAST(NULL AS {t}) AS document_date, CAST('2029-06' AS {t}) AS next_check_at, CAST(NULL AS {t}) AS locked_at, CAST(NULL AS {t}) AS locked_by, "
    "CAST(NULL AS {t}) AS attachment_title, CAST(NULL AS {t}) AS parent_url, CAST(NULL AS {t}) AS page_url, CAST(NULL AS {t}) AS file_url, CAST(NULL AS {t}) AS source, CAST(NULL AS {t}) AS content_type, CAST(NULL AS {t}) AS first_seen_at, CAST(NULL AS {t}) AS last_seen_at"
)
_QUEUE = (
    "{u} AS url, CASE WHEN o_orderkey % 6 = 1 THEN 'announcement' ELSE 'news' END AS category, CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'retry' WHEN 2 THEN 'done' WHEN 3 THEN 'processing' ELSE 'failed' END AS status, "
    "CAST(o_orderkey % 8 AS INT) AS attempts, substr(CAST(o_orderdate AS {t}), 1, 10) AS updated_at, CASE WHEN o_orderkey % 10 < 5 THEN '2029-01' ELSE '2029-12' END AS locked_at, CAST('w' AS {t}) AS locked_by, CAST('e' AS {t}) AS last_error, CAST('2029' AS {t}) AS created_at"
)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet")


def _state(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).selectExpr("o_orderkey", *_split(_STATE.format(u=_URL.format(t="STRING"), t="STRING")))


def _queue(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).selectExpr(*_split(_QUEUE.format(u=_URL.format(t="STRING"), t="STRING")))


def _split(columns: str) -> list[str]:
    """A select list at its commas outside brackets and strings."""
    out, depth, quoted = [""], 0, False
    for c in columns:
        quoted ^= c == "'"
        depth += 0 if quoted else {"(": 1, ")": -1}.get(c, 0)
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


_SQL_STATE = f"s AS (SELECT o_orderkey, {_STATE.format(u=_URL.format(t='VARCHAR'), t='VARCHAR')} FROM orders)"
_SQL_QUEUE = f"q AS (SELECT {_QUEUE.format(u=_URL.format(t='VARCHAR'), t='VARCHAR')} FROM orders)"
_INDEXED = "(indexed_chunks > 0 OR coalesce(trim(last_indexed_at), '') <> '' OR status IN ('indexed', 'indexed_existing', 'unchanged'))"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Line items as the chunks of their order."""
    state = _state(spark, d).select("o_orderkey", "url")
    return spark.read.parquet(f"{d}/lineitem.parquet").join(state, F.col("l_orderkey") == F.col("o_orderkey")).select("url", "l_linenumber")


def q_delete_urls(spark: SparkSession, d: str) -> DataFrame:
    gone = _state(spark, d).where("status = 'gone'")
    return upkeep.delete_urls(_chunks(spark, d), gone).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


def q_delete_gone(spark: SparkSession, d: str) -> DataFrame:
    before = _state(spark, d)
    after = before.withColumn("status", F.when(F.col("status") == "quarantined", "gone").otherwise(F.col("status")))
    return upkeep.delete_gone(_chunks(spark, d), before, after).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("urls"))


def q_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.chunk_counts(_chunks(spark, d).where("l_linenumber > 3"), _state(spark, d))


def q_state_of_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = _orders(spark, d).selectExpr("'https://h/c/' || CAST(o_custkey AS STRING) AS page_url", "CASE WHEN o_orderkey % 2 = 0 THEN 'pdf' ELSE 'page' END AS doc_type", "CASE WHEN o_orderkey % 3 = 0 THEN 'https://h/f/' || CAST(o_custkey AS STRING) ELSE '  ' END AS file_url", "CAST(o_orderkey AS STRING) AS hash", "substr(CAST(o_orderdate AS STRING), 1, 10) AS updated_at", "CAST(NULL AS STRING) AS fetched_at")
    return upkeep.state_of_hits(hits, NOW).select("url", "content_hash", "status", "first_seen_at", "last_indexed_at", "is_active")


def q_attachments(spark: SparkSession, d: str) -> DataFrame:
    """Files become attachments of the page that is one key above, and so does a new URL for every tenth key."""
    state = _state(spark, d)
    files = state.where("o_orderkey % 6 IN (3, 4)").selectExpr("url", "'t' || CAST(o_orderkey AS STRING) AS title", "'https://h/press-sluzhba/novosti/1/' || CAST(o_orderkey - o_orderkey % 6 AS STRING) || '/' AS parent_url")
    fresh = state.where("o_orderkey % 10 = 0").selectExpr("'https://h/n/' || CAST(o_orderkey AS STRING) || '.pdf' AS url", "'new' AS title", "url AS parent_url")
    out = upkeep.upsert_attachments(state.drop("o_orderkey"), files.unionByName(fresh), now=NOW)
    return out.select("url", "status", "document_number", "document_kind", "attachment_title", "parent_url", "next_check_at", "first_seen_at", "is_active")


def q_card_parents(spark: SparkSession, d: str) -> DataFrame:
    state = _state(spark, d)
    rows = state.select("o_orderkey", F.concat(F.lit("https://h/press-sluzhba/novosti/1/"), (F.col("o_orderkey") - F.col("o_orderkey") % 6).cast("string"), F.lit("/")).alias("parent_url"))
    cards = state.where("o_orderkey % 2 = 0").selectExpr("url", "'card' AS document_number", "'  ' AS document_date", "'k' AS document_kind")
    return upkeep.with_card_parents(rows, state, cards).select("o_orderkey", "parent_document_number", "parent_document_date", "parent_document_kind")


def q_seed_publications(spark: SparkSession, d: str) -> DataFrame:
    queue = _queue(spark, d).where("attempts < 4")
    return upkeep.seed_publications(queue, _state(spark, d), now=NOW).select("url", "category", "status", "attempts", "created_at")


def q_prune_publications(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.prune_publications(_queue(spark, d)).select("url")


def q_claim_publications(spark: SparkSession, d: str) -> DataFrame:
    out = upkeep.claim_publications(_queue(spark, d), 25, now=NOW, worker="me")
    return out.select("url", "status", "attempts", "locked_at", "locked_by", "updated_at", "last_error")


def q_release_publications(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.release_publications(_queue(spark, d), before="2029-06", now=NOW).select("url", "status", "locked_at", "locked_by", "updated_at")


def q_publication_report(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.publication_report(_queue(spark, d))


def q_recent_publications(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.recent_publications(_queue(spark, d)).select("url", "status", "updated_at")


def q_release_leases(spark: SparkSession, d: str) -> DataFrame:
    state = _state(spark, d)
    return upkeep.release_leases(state, now=NOW, only=state.where("doc_type = 'page'")).select("url", "status", "next_check_at")


def q_requeue_counts(spark: SparkSession, d: str) -> DataFrame:
    state = _state(spark, d)
    return upkeep.requeue_counts(state, upkeep.release_leases(state, now=NOW))


def q_legacy_report(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.legacy_report(_state(spark, d))


def q_finalize_unsupported(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.finalize_unsupported(_state(spark, d)).select("url", "status", "is_active", "next_check_at")


def q_unsupported_review(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.unsupported_rows(_state(spark, d)).groupBy("kind", "review").agg(F.count(F.lit(1)).alias("n"))


def q_finalize_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.finalize_cleanup(_queue(spark, d), now=NOW).select("url", "status", "locked_by", "updated_at")


def q_terminal(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.terminal(_state(spark, d)).select("url")


def q_top_facets(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.top_facets(_orders(spark, d).selectExpr("CAST(o_custkey AS STRING) AS content_category", "o_orderpriority AS url"))


def q_missing_values(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.missing_values(_state(spark, d), ("document_number", "document_kind", "document_date"))


def q_page_fold(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("int").alias("page_number")).agg((F.max("l_quantity") > 20).alias("readable"), (F.max("l_discount") == 0).alias("blank"))
    pages = lines.withColumn("force", F.col("page_number") == 1)
    return upkeep.page_fold(pages, "doc", most=3, coverage=2).select("doc", F.col("page_number").cast("long").alias("page_number"), "decision", F.col("attempt").cast("long").alias("attempt"))


def q_empty_pages(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of recognised words, with a row for orders that have none."""
    words = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("page"), (F.col("l_quantity") * 2 - 30).alias("conf"), F.col("l_returnflag").alias("text"))
    pages = _orders(spark, d).select(F.col("o_orderkey").alias("page"))
    return reports.page_confidence(pages, words, "page").select("page", F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), "words")


_PARENT = "'https://h/press-sluzhba/novosti/1/' || CAST(o_orderkey - o_orderkey % 6 AS VARCHAR) || '/'"
_CHUNKS = "c AS (SELECT url, l_linenumber FROM lineitem JOIN s ON l_orderkey = o_orderkey)"
_PUBLISHED = "(regexp_matches(url, '/press-sluzhba/novosti/\\d+/\\d+/?$') OR regexp_matches(url, '/press-sluzhba/obyavleniya/\\d+/?$'))"
_W = f"WITH {_SQL_STATE}, "
QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}
ORACLE = {
    "q_delete_urls": f"{_W}{_CHUNKS} SELECT url, count(*) AS n FROM c WHERE url NOT IN (SELECT url FROM s WHERE status = 'gone') GROUP BY 1",
    "q_delete_gone": f"{_W}{_CHUNKS} SELECT count(*) AS n, count(DISTINCT url) AS urls FROM c WHERE url NOT IN (SELECT url FROM s WHERE status = 'quarantined')",
    "q_chunk_counts": f"{_W}{_CHUNKS} SELECT s.url, count(l_linenumber) FILTER (l_linenumber > 3) AS n FROM s LEFT JOIN c USING (url) GROUP BY 1",
    "q_state_of_hits": "WITH h AS (SELECT CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'https://h/f/' ELSE 'https://h/c/' END || CAST(o_custkey AS VARCHAR) AS url, CAST(o_orderkey AS VARCHAR) AS hash, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS u FROM orders) "
    "SELECT url, hash AS content_hash, 'indexed_existing' AS status, u AS first_seen_at, u AS last_indexed_at, 1 AS is_active FROM h QUALIFY row_number() OVER (PARTITION BY url ORDER BY u DESC, hash DESC) = 1",
    "q_attachments": f"{_W}l AS (SELECT url, 't' || CAST(o_orderkey AS VARCHAR) AS title, {_PARENT} AS parent FROM s WHERE o_orderkey % 6 IN (3, 4) UNION ALL SELECT 'https://h/n/' || CAST(o_orderkey AS VARCHAR) || '.pdf', 'new', url FROM s WHERE o_orderkey % 10 = 0), "
    "t AS (SELECT l.*, p.document_number AS num, p.document_kind AS kind FROM l LEFT JOIN s AS p ON p.url = l.parent) "
    "SELECT coalesce(s.url, t.url) AS url, CASE WHEN s.url IS NULL OR (t.url IS NOT NULL AND s.status IN ('gone', 'quarantined')) THEN 'discovered' ELSE s.status END AS status, coalesce(t.num, s.document_number) AS document_number, coalesce(t.kind, s.document_kind) AS document_kind, "
    f"t.title AS attachment_title, t.parent AS parent_url, CASE WHEN s.url IS NULL OR (t.url IS NOT NULL AND s.status IN ('gone', 'quarantined')) THEN '{NOW}' ELSE s.next_check_at END AS next_check_at, CASE WHEN s.url IS NULL THEN '{NOW}' END AS first_seen_at, CASE WHEN t.url IS NOT NULL THEN 1 ELSE s.is_active END AS is_active FROM s FULL JOIN t ON s.url = t.url",
    "q_card_parents": f"{_W}r AS (SELECT o_orderkey, {_PARENT} AS p FROM s) SELECT r.o_orderkey, coalesce(k.document_number, CASE WHEN k.o_orderkey % 2 = 0 THEN 'card' END) AS parent_document_number, CAST(NULL AS VARCHAR) AS parent_document_date, k.document_kind AS parent_document_kind FROM r LEFT JOIN s AS k ON k.url = r.p",
    "q_seed_publications": f"{_W}{_SQL_QUEUE}, o AS (SELECT * FROM q WHERE attempts < 4) SELECT url, category, status, attempts, created_at FROM o UNION ALL SELECT url, CASE WHEN o_orderkey % 6 = 0 THEN 'news' ELSE 'announcement' END, 'pending', 0, '{NOW}' FROM s WHERE is_active = 1 AND o_orderkey % 6 < 2 AND url NOT IN (SELECT url FROM o)",
    "q_prune_publications": f"WITH {_SQL_QUEUE} SELECT url FROM q WHERE {_PUBLISHED}",
    "q_claim_publications": f"WITH {_SQL_QUEUE}, k AS (SELECT url FROM q WHERE status IN ('pending', 'retry') AND attempts < 5 ORDER BY attempts, updated_at, url LIMIT 25) "
    f"SELECT q.url, CASE WHEN k.url IS NULL THEN status ELSE 'processing' END AS status, attempts + CASE WHEN k.url IS NULL THEN 0 ELSE 1 END AS attempts, CASE WHEN k.url IS NULL THEN locked_at ELSE '{NOW}' END AS locked_at, CASE WHEN k.url IS NULL THEN locked_by ELSE 'me' END AS locked_by, CASE WHEN k.url IS NULL THEN updated_at ELSE '{NOW}' END AS updated_at, CASE WHEN k.url IS NULL THEN last_error END AS last_error FROM q LEFT JOIN k USING (url)",
    "q_release_publications": f"WITH {_SQL_QUEUE}, x AS (SELECT *, status = 'processing' AND locked_at < '2029-06' AS stale FROM q) SELECT url, CASE WHEN stale THEN 'retry' ELSE status END AS status, CASE WHEN NOT stale THEN locked_at END AS locked_at, CASE WHEN NOT stale THEN locked_by END AS locked_by, CASE WHEN stale THEN '{NOW}' ELSE updated_at END AS updated_at FROM x",
    "q_publication_report": f"WITH {_SQL_QUEUE} SELECT 'status' AS part, status AS name, count(*) AS n, count(*) FILTER (status = 'done') AS done FROM q GROUP BY status UNION ALL SELECT 'category', category, count(*), count(*) FILTER (status = 'done') FROM q GROUP BY category",
    "q_recent_publications": f"WITH {_SQL_QUEUE} SELECT url, status, updated_at FROM q ORDER BY updated_at DESC, url LIMIT 10",
    "q_release_leases": f"{_W}x AS (SELECT *, status = 'processing' AND doc_type = 'page' AS h FROM s) SELECT url, CASE WHEN h THEN 'retry' ELSE status END AS status, CASE WHEN h THEN '{NOW}' ELSE next_check_at END AS next_check_at FROM x",
    "q_requeue_counts": f"{_W}x AS (SELECT 1) SELECT doc_type, count(*) AS n FROM s WHERE status = 'processing' GROUP BY 1",
    "q_legacy_report": f"{_W}x AS (SELECT 1) SELECT '/content/detail.php' AS path, count(*) AS n FROM s WHERE o_orderkey % 6 = 2 AND NOT (is_active = 0 AND status = 'gone') AND NOT {_INDEXED} HAVING count(*) > 0",
    "q_finalize_unsupported": f"{_W}x AS (SELECT *, o_orderkey % 6 IN (3, 4) AND is_active <> 0 AND NOT {_INDEXED} AS e FROM s) SELECT url, CASE WHEN e THEN 'skipped_unsupported' ELSE status END AS status, CASE WHEN e THEN 0 ELSE is_active END AS is_active, CASE WHEN NOT e THEN next_check_at END AS next_check_at FROM x",
    "q_unsupported_review": f"{_W}x AS (SELECT 1) SELECT CASE o_orderkey % 6 WHEN 3 THEN 'archive' ELSE 'old_office' END AS kind, {_INDEXED} AS review, count(*) AS n FROM s WHERE o_orderkey % 6 IN (3, 4) AND is_active <> 0 GROUP BY ALL",
    "q_finalize_cleanup": f"WITH {_SQL_QUEUE}, x AS (SELECT *, status IN ('pending', 'processing', 'retry') AND NOT {_PUBLISHED} AS e FROM q) SELECT url, CASE WHEN e THEN 'skipped_out_of_scope' ELSE status END AS status, CASE WHEN NOT e THEN locked_by END AS locked_by, CASE WHEN e THEN '{NOW}' ELSE updated_at END AS updated_at FROM x",
    "q_terminal": f"{_W}x AS (SELECT 1) SELECT url FROM s WHERE status IN ('gone', 'quarantined') OR is_active = 0",
    "q_top_facets": "SELECT CAST(o_custkey AS VARCHAR) AS category, count(*) AS chunks, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 32",
    "q_missing_values": f"{_W}x AS (SELECT 1) SELECT 'document_number' AS \"column\", count(document_number) AS present, count(*) - count(document_number) AS missing FROM s UNION ALL SELECT 'document_kind', count(document_kind), count(*) - count(document_kind) FROM s UNION ALL SELECT 'document_date', 0, count(*) FROM s",
    "q_page_fold": "WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS n, max(l_quantity) > 20 AS readable, max(l_discount) = 0 AS blank FROM lineitem GROUP BY 1, 2), "
    "w AS (SELECT *, (NOT readable OR n = 1) AS wants, NOT blank AND (NOT readable OR n = 1) AS tries FROM p), c AS (SELECT *, count(*) FILTER (tries) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM w) "
    "SELECT doc, CAST(n AS BIGINT) AS page_number, CASE WHEN wants AND k < 2 THEN CASE WHEN blank THEN 'blank' ELSE 'ocr' END WHEN wants THEN 'deferred' ELSE 'native' END AS decision, CASE WHEN tries AND k < 2 THEN k + 1 END AS attempt FROM c",
    "q_empty_pages": "WITH w AS (SELECT l_orderkey AS page, l_quantity * 2 - 30 AS conf FROM lineitem WHERE l_quantity * 2 - 30 >= 0) SELECT o_orderkey AS page, round(coalesce(avg(conf), 0), 6) AS mean, round(coalesce(avg(CASE WHEN conf < 60 THEN 1.0 WHEN conf >= 60 THEN 0.0 END), 1), 6) AS low, count(conf) AS words FROM orders LEFT JOIN w ON page = o_orderkey GROUP BY 1",
}
