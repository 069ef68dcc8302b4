"""The crawl queue: immutable snapshots of URL states, and pure functions from one snapshot to the next.

A snapshot is a table with one row for each URL.  Upserts are full outer joins
on the key (Parquet has no merge), transitions are one expression tree, and
times are ISO strings, which order as times do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The statuses in the order of the queue, and their groups.
QUEUE_ORDER = ("discovered", "indexed_existing", "retry", "missing", "indexed", "unchanged", "skipped_empty")
TYPE_ORDER = ("page", "pdf", "file")
LOADED = ("indexed", "indexed_existing", "unchanged")
PROBLEM = ("failed", "missing", "quarantined", "retry", "skipped_corrupt")
TERMINAL = ("gone", "quarantined", "skipped_corrupt", "skipped_unsupported", "skipped_too_large")
SKIPS = ("skipped_empty", "skipped_corrupt", "skipped_unsupported", "skipped_too_large")


def _rank(c: Column, order: tuple[str, ...]) -> Column:
    out = F.when(c == order[0], 0)
    for k, v in enumerate(order[1:], 1):
        out = out.when(c == v, k)
    return out.otherwise(len(order))


def candidates(state: DataFrame, *, now: str, force: bool = False, url: str | None = None, exact: bool = False, need_version: str | None = None, need_index: bool = False) -> DataFrame:
    """Rows that may be worked on, with their ranks: formats take turns within a status."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = state.where("is_active = 1 AND status <> 'processing'")
    if need_version:
        rows = rows.where((F.lower(empty("doc_type")) == "pdf") & (empty("extraction_version") != need_version))
    if need_index:
        rows = rows.where((F.coalesce("indexed_chunks", F.lit(0)) > 0) | F.col("status").isin(*LOADED))
    if url:
        rows = rows.where((F.col("url") == url) | (F.lit(not exact) & ((F.col("page_url") == url) | (F.col("file_url") == url))))
    elif not force:
        rows = rows.where(F.col("next_check_at").isNull() | (F.col("next_check_at") <= now))
    rows = rows.withColumn("status_rank", _rank(F.col("status"), QUEUE_ORDER)).withColumn("type_rank", _rank(F.lower(empty("doc_type")), TYPE_ORDER))
    turn = Window.partitionBy("status", "type_rank").orderBy(empty("next_check_at"), empty("last_checked_at"), "url")
    return rows.withColumn("turn", F.row_number().over(turn))


def queue_order() -> list[Column]:
    return [F.col("status_rank"), F.col("turn"), F.col("type_rank"), F.coalesce("next_check_at", F.lit("")), F.coalesce("last_checked_at", F.lit("")), F.col("url")]


def with_parents(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Number, date and kind of the parent page, by one left join on its unique URL."""
    parents = state.select(F.col("url").alias("_url"), *[F.col(c).alias(f"parent_{c}") for c in ("document_number", "document_date", "document_kind")])
    return rows.join(parents, F.col("parent_url") == F.col("_url"), "left").drop("_url")


def inherit(state: DataFrame) -> DataFrame:
    """PDFs and files take over what their parent has and they don't agree with."""
    joined = with_parents(state, state)
    for c in ("document_number", "document_date", "document_kind"):
        joined = joined.withColumn(c, F.when(F.col("doc_type").isin("pdf", "file") & F.col(f"parent_{c}").isNotNull(), F.col(f"parent_{c}")).otherwise(F.col(c))).drop(f"parent_{c}")
    return joined


def authoritative(parent: Column, title: Column) -> Column:
    """The parent's value, else the one of the attachment's title; the file's own text doesn't count."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(parent), blank(title))


def claim(state: DataFrame, chosen: DataFrame, *, now: str, worker: str) -> DataFrame:
    """Lease the chosen URLs: the caller is the only writer of snapshots."""
    took = F.col("_url").isNotNull()
    joined = state.join(chosen.select(F.col("url").alias("_url")), F.col("url") == F.col("_url"), "left")
    return joined.withColumns({"status": F.when(took, "processing").otherwise(F.col("status")), "locked_at": F.when(took, now).otherwise(F.col("locked_at")), "locked_by": F.when(took, worker).otherwise(F.col("locked_by"))}).drop("_url")


def release_stale(state: DataFrame, *, before: str, now: str, workers: DataFrame | None = None) -> DataFrame:
    """Leases from before a time, or of workers that aren't in `workers` (locked_by), go back to the queue, due at once."""
    stale = (F.col("status") == "processing") & (F.col("locked_at").isNull() | (F.col("locked_at") < before))
    if workers is not None:
        alive = workers.select(F.col("locked_by").alias("_w")).distinct()
        state = state.join(alive, F.col("locked_by") == F.col("_w"), "left")
        stale = stale | ((F.col("status") == "processing") & F.col("_w").isNull())
    out = state.withColumn("_stale", stale)
    for c, v in (("next_check_at", F.lit(now)), ("locked_at", F.lit(None)), ("locked_by", F.lit(None)), ("status", F.lit("retry"))):
        out = out.withColumn(c, F.when(F.col("_stale"), v).otherwise(F.col(c)))
    return out.drop("_stale", "_w")


def transition(state: DataFrame, events: DataFrame, *, recheck: str, retry: str, missing: str, attempts: int = 5, absences: int = 3) -> DataFrame:
    """Apply one event to each URL that has one (url, event): the three times are when to look again.

    Events: not_modified, same_source, same_content, indexed, not_found,
    http_error, error, and the four skips.  Any other raises.
    """
    e, count = F.col("event"), lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = state.join(events.select(F.col("url").alias("_url"), "event"), F.col("url") == F.col("_url"), "left")
    same, lost, http, broken = e.isin("not_modified", "same_source", "same_content"), e == "not_found", e == "http_error", e == "error"
    absent, failed = count("consecutive_missing") + 1, count("failure_count") + 1
    gone, out = lost & (absent >= absences), http & (failed >= attempts)
    final = e.isin(*SKIPS[1:])
    known = same | (e == "indexed") | lost | http | broken | e.isin(*SKIPS)
    status = F.when(e.isNull(), F.col("status")).when(same, "unchanged").when(e == "indexed", "indexed").when(gone, "gone").when(lost, "missing").when(out, "quarantined").when(http | broken, "retry").when(e.isin(*SKIPS), e)
    status = status.otherwise(F.when(~known, F.raise_error(F.concat(F.lit("no such event: "), e))))
    keep = lambda c, v: F.when(e.isNull(), F.col(c)).otherwise(v)
    return joined.withColumns(
        {
            "status": status,
            "attempt_count": keep("attempt_count", count("attempt_count") + 1),
            "failure_count": keep("failure_count", F.when(lost | http | broken, failed).otherwise(0)),
            "consecutive_missing": keep("consecutive_missing", F.when(lost, absent).when(same | (e == "indexed"), 0).otherwise(count("consecutive_missing"))),
            "is_active": keep("is_active", F.when(gone | out | final, 0).otherwise(1)),
            "next_check_at": keep("next_check_at", F.when(out | final, F.lit(None)).when(lost, missing).when(http | broken, retry).otherwise(F.lit(recheck))),
        }
    ).drop("_url", "event")


def upsert(target: DataFrame, new: DataFrame, key: str, *, keep_old: tuple[str, ...] = (), replace: tuple[str, ...] = ()) -> DataFrame:
    """Full outer join on a unique key: new values that aren't null win; `replace` always, `keep_old` never over an old row."""
    other = new.select(*[F.col(c).alias(f"_n_{c}") for c in new.columns])
    joined = target.join(other, F.col(key) == F.col(f"_n_{key}"), "full")
    fresh, there = F.col(f"_n_{key}").isNotNull(), F.col(key).isNotNull()
    out = []
    for c in target.columns:
        if c not in new.columns:
            out.append(F.col(c))
        elif c in keep_old:
            out.append(F.when(there, F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c))
        elif c in replace:
            out.append(F.when(fresh, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c))
    return joined.select(*out)


def insert_new(target: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows with keys that aren't there yet; others are left alone."""
    return target.unionByName(new.join(target.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys)), allowMissingColumns=True)


def revive(state: DataFrame, seen: DataFrame, *, now: str, statuses: tuple[str, ...] = ("gone",)) -> DataFrame:
    """URLs that are seen again start anew."""
    again = F.col("_url").isNotNull() & F.col("status").isin(*statuses)
    joined = state.join(seen.select(F.col("url").alias("_url")).distinct(), F.col("url") == F.col("_url"), "left").withColumn("_again", again)
    for c, v in (("is_active", F.lit(1)), ("next_check_at", F.lit(now)), ("status", F.lit("discovered"))):
        joined = joined.withColumn(c, F.when(F.col("_again"), v).otherwise(F.col(c)))
    return joined.drop("_url", "_again")


def reconcile(queue: DataFrame, state: DataFrame) -> DataFrame:
    """Publication queue against the crawl: URLs that ended are skipped, URLs that are now indexed wait again."""
    ended = state.where(F.col("status").isin("gone", "quarantined", "skipped_corrupt", "skipped_unsupported") | (F.col("is_active") == 0)).select(F.col("url").alias("_ended"))
    there = state.where((F.col("is_active") == 1) & F.col("status").isin(*LOADED)).select(F.col("url").alias("_there"))
    joined = queue.join(ended, F.col("url") == F.col("_ended"), "left").join(there, F.col("url") == F.col("_there"), "left")
    again = F.col("_there").isNotNull() & (F.col("status") == "not_indexed")
    status = F.when(F.col("_ended").isNotNull() & ~F.col("status").isin("done", "skipped"), "skipped").when(again, "pending").otherwise(F.col("status"))
    return joined.withColumns({"attempts": F.when(again & F.col("_ended").isNull(), 0).otherwise(F.col("attempts")), "status": status}).drop("_ended", "_there")


def publication_step(queue: DataFrame, events: DataFrame, attempts: int = 5) -> DataFrame:
    """One event (url, event: found, no_date, not_indexed, gone, failed) for rows in work; the last attempt fails for good."""
    e = F.col("event")
    joined = queue.join(events.select(F.col("url").alias("_url"), "event"), F.col("url") == F.col("_url"), "left")
    n = F.col("attempts") + F.when(e.isNull(), 0).otherwise(1)
    status = F.when(e.isNull(), F.col("status")).when(e == "found", "done").when(e == "no_date", "no_date").when(e == "not_indexed", "not_indexed").when(e == "gone", "skipped").when(n >= attempts, "failed").otherwise("retry")
    return joined.withColumns({"status": status, "attempts": n}).drop("_url", "event")


def requeue(state: DataFrame, *, now: str, doc_types: tuple[str, ...] = (), like: str | None = None, without_requisites: bool = False, limit: int | None = None) -> DataFrame:
    """Processed rows to be fetched anew, the longest unindexed first: due now, without hashes or lease; the status stays."""
    rows = state.where((F.col("is_active") == 1) & F.col("status").isin(*LOADED, "skipped_empty"))
    if doc_types:
        rows = rows.where(F.lower("doc_type").isin(*doc_types))
    if like:
        rows = rows.where(F.col("url").ilike(like))
    if without_requisites:
        rows = rows.where(F.coalesce("document_number", F.lit("")) == "")
    if limit is not None:
        rows = rows.orderBy(F.asc_nulls_first("last_indexed_at"), "url").limit(limit)
    chosen = F.col("_url").isNotNull()
    joined = state.join(rows.select(F.col("url").alias("_url")), F.col("url") == F.col("_url"), "left").withColumn("next_check_at", F.when(chosen, now).otherwise(F.col("next_check_at")))
    for c in ("content_hash", "source_hash", "etag", "last_modified", "locked_at", "locked_by"):
        if c in state.columns:
            joined = joined.withColumn(c, F.when(~chosen, F.col(c)))
    return joined.drop("_url")


def replace_rows(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Overwrite by key (bulk index): new rows instead of old ones with the same key."""
    return target.join(new.select(key), key, "left_anti").unionByName(new)


def delete_stale(chunks: DataFrame, current: DataFrame) -> DataFrame:
    """Chunks without those of a URL in `current` (url, hash) that have another hash."""
    old = chunks.alias("c").join(current.select(F.col("url").alias("_url"), F.col("hash").alias("_hash")), F.col("c.url") == F.col("_url"), "left")
    return old.where(F.col("_url").isNull() | F.col("c.hash").eqNullSafe(F.col("_hash"))).select("c.*")


def close_legacy(state: DataFrame, is_legacy: Column) -> DataFrame:
    """Dead detail pages: gone for good, at least three absences, 404 if no answer is known."""
    out = state.withColumn("_l", is_legacy)
    for c, v in (("consecutive_missing", F.greatest(F.coalesce("consecutive_missing", F.lit(0)), F.lit(3))), ("http_status", F.coalesce("http_status", F.lit(404))), ("is_active", F.lit(0)), ("next_check_at", F.lit(None)), ("status", F.lit("gone"))):
        if c in state.columns:
            out = out.withColumn(c, F.when(F.col("_l"), v).otherwise(F.col(c)))
    return out.drop("_l")


def publish_dates(chunks: DataFrame, dates: DataFrame) -> DataFrame:
    """Set published_at on all chunks of a URL in `dates` (url, published_at); acts keep their own date for sorting."""
    new = dates.select(F.col("url").alias("_url"), F.col("published_at").alias("_at"))
    joined = chunks.join(new, F.col("url") == F.col("_url"), "left")
    act = F.nullif(F.col("document_date"), F.lit(""))
    there = F.col("_url").isNotNull()
    return joined.withColumns({"sort_date": F.when(there, F.coalesce(act, F.col("_at"))).otherwise(F.col("sort_date")), "published_at": F.when(there, F.col("_at")).otherwise(F.col("published_at"))}).drop("_url", "_at")


def reset_status(queue: DataFrame, status: str, *, now: str) -> DataFrame:
    """Rows of a status are tried again from the start."""
    chosen = F.col("_c")
    out = queue.withColumn("_c", F.col("status") == status)
    for c, v in (("attempts", F.lit(0)), ("last_error", F.lit(None)), ("locked_at", F.lit(None)), ("locked_by", F.lit(None)), ("updated_at", F.lit(now)), ("status", F.lit("retry"))):
        if c in queue.columns:
            out = out.withColumn(c, F.when(chosen, v).otherwise(F.col(c)))
    return out.drop("_c")
