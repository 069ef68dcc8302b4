"""Upkeep of the crawl: attachments, the publication queue, maintenance of old rows, deletes, backups.

As in `state`, a step takes a snapshot and gives the next one; reports are one
grouped pass.  Joined columns travel as one struct, so that no name of the
snapshot's own columns can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import urls

from .state import LOADED, TERMINAL, upsert

# What happens to a row that no one will fetch, and the paths of single news items and announcements.
UNSUPPORTED, OUT_OF_SCOPE = "skipped_unsupported", "skipped_out_of_scope"
OPEN = ("pending", "processing", "retry")
NEWS_ITEM, ANNOUNCEMENT_ITEM = r"(?i)^/press-sluzhba/novosti/\d+/\d+/?$", r"(?i)^/press-sluzhba/obyavleniya/\d+/?$"
_WITH = "_joined"


def _with(rows: DataFrame, other: DataFrame, key: str = "url") -> DataFrame:
    """rows with a struct `_joined` of the row of `other` (unique by key) that has the same key; null if there is none."""
    side = other.select(F.struct(*other.columns).alias(_WITH))
    return rows.join(side, F.col(key) == F.col(f"{_WITH}.{key}"), "left")


def _set(rows: DataFrame, chosen: Column, values: dict[str, Column]) -> DataFrame:
    """New values in the chosen rows, for columns that are there; all are read from the old row."""
    return rows.withColumns({c: F.when(chosen, v).otherwise(F.col(c)) for c, v in values.items() if c in rows.columns})


# ---- chunks ----------------------------------------------------------------------


def delete_urls(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks without those of the URLs in `gone` (url)."""
    return chunks.join(gone.select("url").distinct(), "url", "left_anti")


def delete_gone(chunks: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Chunks without those of URLs that a step made `gone`: what was gone before has no chunks any more."""
    fresh = after.where("status = 'gone'").select("url").join(before.where("status = 'gone'").select("url"), "url", "left_anti")
    return delete_urls(chunks, fresh)


def chunk_counts(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """url, n for each URL in `wanted`, 0 where it has no chunks."""
    counts = chunks.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    return wanted.select("url").distinct().join(counts, "url", "left").select("url", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def state_of_hits(hits: DataFrame, observed_at: str) -> DataFrame:
    """State rows for the documents of an index: one for each URL, what is known of its times, status indexed_existing.

    Of a URL's hits the one updated last counts; hits without any URL are left out.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in hits.columns else F.lit(None).cast("string")
    first = F.when(F.lower(F.coalesce(blank("doc_type"), F.lit(""))).isin("pdf", "file"), F.coalesce(blank("file_url"), blank("url"), blank("page_url"))).otherwise(F.coalesce(blank("page_url"), blank("url"), blank("file_url")))
    fetched, updated = blank("fetched_at"), blank("updated_at")
    rows = hits.select(
        first.alias("url"), *[blank(c).alias(c) for c in ("page_url", "file_url", "source", "doc_type", "content_type")], blank("hash").alias("content_hash"),
        F.lit("indexed_existing").alias("status"), F.lit(0).alias("attempt_count"), F.lit(0).alias("failure_count"), F.coalesce(fetched, updated, F.lit(observed_at)).alias("first_seen_at"), F.lit(observed_at).alias("last_seen_at"),
        fetched.alias("last_fetched_at"), F.coalesce(updated, fetched).alias("last_indexed_at"), updated.alias("source_updated_at"), F.lit(1).alias("is_active"),
    )
    kept = rows.where("url IS NOT NULL")
    best = F.max_by(F.struct(*kept.columns), F.struct(F.coalesce("last_indexed_at", F.lit("")), F.coalesce("content_hash", F.lit(""))))
    return kept.groupBy(F.col("url").alias("_key")).agg(best.alias("r")).select("r.*")


# ---- attachments -----------------------------------------------------------------


def upsert_attachments(state: DataFrame, links: DataFrame, *, now: str) -> DataFrame:
    """Attachments (url, title, parent_url) become state rows that take number, date and kind of their parent.

    Known URLs keep their own values where the parent has none; those that were
    given up start anew.  A link that stands on several pages takes the last by parent URL.
    """
    one = links.groupBy("url").agg(F.max_by(F.struct("parent_url", "title"), F.struct("parent_url", "title")).alias("l")).select("url", "l.parent_url", F.col("l.title").alias("attachment_title"))
    meta = ("document_number", "document_date", "document_kind")
    parents = state.select(F.col("url").alias("_p"), *[(F.col(c) if c in state.columns else F.lit(None).cast("string")).alias(c) for c in meta])
    told = one.join(parents, F.col("parent_url") == F.col("_p"), "left").drop("_p")
    new = told.select(
        "url", F.col("parent_url").alias("page_url"), F.col("url").alias("file_url"), F.lit("attachment").alias("source"), F.lit("pdf").alias("doc_type"), F.lit("application/pdf").alias("content_type"), F.lit("discovered").alias("status"),
        F.lit(now).alias("first_seen_at"), F.lit(now).alias("last_seen_at"), F.lit(now).alias("next_check_at"), F.lit(1).alias("is_active"), "parent_url", "attachment_title", *meta,
    )
    back = _with(state, new.select("url")).where(F.col(f"{_WITH}.url").isNotNull() & F.col("status").isin("gone", "quarantined")).select("url")
    merged = upsert(state, new.select(*[c for c in new.columns if c in state.columns]), "url", keep_old=("source", "doc_type", "content_type", "status", "first_seen_at", "next_check_at"))
    again = F.col(f"{_WITH}.url").isNotNull()
    return _set(_with(merged, back), again, {"status": F.lit("discovered"), "next_check_at": F.lit(now)}).drop(_WITH)


def with_card_parents(rows: DataFrame, state: DataFrame, cards: DataFrame) -> DataFrame:
    """Number, date and kind of each row's parent: from the state, and where it lacks them from its page as read again (cards)."""
    meta = ("document_number", "document_date", "document_kind")
    known, read = (t.select(F.struct(F.col("url"), *[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in meta]).alias(n)) for t, n in ((state, "_known"), (cards, "_read")))
    joined = rows.join(known, F.col("parent_url") == F.col("_known.url"), "left").join(read, F.col("parent_url") == F.col("_read.url"), "left")
    return joined.withColumns({f"parent_{c}": F.coalesce(F.col(f"_known.{c}"), F.col(f"_read.{c}")) for c in meta}).drop("_known", "_read")


# ---- the publication queue ---------------------------------------------------------


def seed_publications(queue: DataFrame, state: DataFrame, *, now: str) -> DataFrame:
    """News and announcements that are active wait in the queue; what is there already stays as it is."""
    kind = urls.publication_kind(F.col("url"))
    found = state.where((F.col("is_active") == 1) & (F.trim(F.coalesce("url", F.lit(""))) != "") & kind.isNotNull()).select("url", kind.alias("category")).distinct()
    new = found.join(queue.select("url"), "url", "left_anti").select("url", "category", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
    return queue.unionByName(new, allowMissingColumns=True)


def prune_publications(queue: DataFrame) -> DataFrame:
    """The queue without URLs that are neither news nor announcements."""
    return queue.where(urls.publication_kind(F.col("url")).isNotNull())


def publication_order() -> list[Column]:
    return [F.asc("attempts"), F.asc("updated_at"), F.asc("url")]


def claim_publications(queue: DataFrame, limit: int, *, now: str, worker: str, attempts: int = 5) -> DataFrame:
    """Lease the first `limit` waiting rows: each claim is an attempt."""
    chosen = queue.where(F.col("status").isin("pending", "retry") & (F.col("attempts") < attempts)).orderBy(*publication_order()).limit(limit)
    joined = _with(queue, chosen.select("url"))
    took = F.col(f"{_WITH}.url").isNotNull()
    values = {"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "locked_at": F.lit(now), "locked_by": F.lit(worker), "updated_at": F.lit(now), "last_error": F.lit(None)}
    return _set(joined, took, values).drop(_WITH)


def release_publications(queue: DataFrame, *, before: str, now: str) -> DataFrame:
    """Leases from before a time (30 minutes ago) go back to the queue."""
    stale = (F.col("status") == "processing") & (F.col("locked_at").isNull() | (F.col("locked_at") < before))
    return _set(queue, stale, {"status": F.lit("retry"), "locked_at": F.lit(None), "locked_by": F.lit(None), "updated_at": F.lit(now)})


def publication_report(queue: DataFrame) -> DataFrame:
    """part, name, n, done: a row for each status and each category."""
    by = lambda c: queue.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "done").alias("done")).select(F.lit(c).alias("part"), "name", "n", "done")
    return by("status").unionByName(by("category"))


def recent_publications(queue: DataFrame, k: int = 10) -> DataFrame:
    """The rows that changed last (a report's limit)."""
    return queue.orderBy(F.desc("updated_at"), "url").limit(k)


# ---- leases, requeue counts ------------------------------------------------------


def release_leases(state: DataFrame, *, now: str, only: DataFrame | None = None) -> DataFrame:
    """All leases, or those of the URLs in `only`, go back to the queue, due at once."""
    rows = state if only is None else _with(state, only.select("url").distinct())
    held = (F.col("status") == "processing") & (F.lit(True) if only is None else F.col(f"{_WITH}.url").isNotNull())
    return _set(rows, held, {"status": F.lit("retry"), "next_check_at": F.lit(now), "locked_at": F.lit(None), "locked_by": F.lit(None)}).drop(_WITH)


def requeue_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_type, n of rows that a requeue made due: their time changed and their hash is gone."""
    old = before.select(F.struct("url", "next_check_at").alias(_WITH))
    changed = after.join(old, F.col("url") == F.col(f"{_WITH}.url")).where(~F.col("next_check_at").eqNullSafe(F.col(f"{_WITH}.next_check_at")))
    return changed.groupBy(F.coalesce("doc_type", F.lit("")).alias("doc_type")).agg(F.count(F.lit(1)).alias("n"))


# ---- maintenance -------------------------------------------------------------------


def was_indexed(state: DataFrame) -> Column:
    """Has a row ever had chunks?  Such rows are for a person to look at."""
    there = lambda c, v: F.coalesce(v, F.lit(False)) if c in state.columns else F.lit(False)
    return there("indexed_chunks", F.col("indexed_chunks") > 0) | there("last_indexed_at", F.trim("last_indexed_at") != "") | there("status", F.col("status").isin(*LOADED))


def legacy_rows(state: DataFrame) -> DataFrame:
    """Rows of dead detail pages that aren't closed yet, with `review` where they were indexed once."""
    closed = (F.coalesce("is_active", F.lit(0)) == 0) & (F.col("status") == "gone")
    return state.where(urls.is_legacy_detail(F.col("url")) & ~closed).withColumn("review", was_indexed(state))


def legacy_report(state: DataFrame) -> DataFrame:
    """path, n: how many dead detail pages would be closed, by path."""
    bare = F.lower(F.regexp_replace(urls.path(F.col("url")), "/+$", ""))
    return legacy_rows(state).where("NOT review").groupBy(bare.alias("path")).agg(F.count(F.lit(1)).alias("n"))


def unsupported_rows(state: DataFrame) -> DataFrame:
    """Active rows of archives and old office formats, with kind and `review`."""
    u = F.col("url")
    kind = F.when(urls.is_archive(u), "archive").when(urls.is_unsupported_office(u), "old_office")
    return state.where((F.coalesce("is_active", F.lit(0)) != 0) & kind.isNotNull()).withColumn("kind", kind).withColumn("review", was_indexed(state))


def finalize_unsupported(state: DataFrame, error: str = "format is not indexed") -> DataFrame:
    """Archives and old office formats that were never indexed end for good."""
    joined = _with(state, unsupported_rows(state).where("NOT review").select("url"))
    ended = F.col(f"{_WITH}.url").isNotNull()
    return _set(joined, ended, {"status": F.lit(UNSUPPORTED), "is_active": F.lit(0), "next_check_at": F.lit(None), "locked_at": F.lit(None), "locked_by": F.lit(None), "last_error": F.lit(error)}).drop(_WITH)


def finalize_cleanup(queue: DataFrame, *, now: str) -> DataFrame:
    """Open cleanup tasks that are neither news items nor announcements are out of scope."""
    p = urls.path(F.col("url"))
    outside = F.col("status").isin(*OPEN) & ~F.coalesce(F.rlike(p, F.lit(NEWS_ITEM)) | F.rlike(p, F.lit(ANNOUNCEMENT_ITEM)), F.lit(False))
    return _set(queue, outside, {"status": F.lit(OUT_OF_SCOPE), "locked_at": F.lit(None), "locked_by": F.lit(None), "updated_at": F.lit(now)})


def migrate(spark: SparkSession, folder: str, version: str, steps: dict[str, DataFrame], review: DataFrame) -> int:
    """All or nothing: new snapshots are written beside the old ones, and only a last small write makes them current.

    Nothing is published where rows are left for review; their number is returned.
    A run that fails before the pointer leaves the old version current, and one
    that is repeated writes the same snapshots again.
    """
    left = review.count()
    if left:
        return left
    for name, table in steps.items():
        table.write.mode("overwrite").parquet(f"{folder}/{version}/{name}")
    spark.createDataFrame([(version,)], "version string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/pointer")
    return 0


def current_version(spark: SparkSession, folder: str) -> str:
    return spark.read.parquet(f"{folder}/pointer").agg(F.max_by("version", "at")).first()[0]


# ---- backups -----------------------------------------------------------------------


def digest(table: DataFrame) -> tuple[int, int]:
    """Rows and an order-free hash of all values."""
    row = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def backup(table: DataFrame, folder: str) -> str:
    """A copy of a snapshot that is read back and compared; "ok", or what differs."""
    table.write.mode("overwrite").parquet(folder)
    want, got = digest(table), digest(table.sparkSession.read.parquet(folder))
    return "ok" if want == got else f"rows and hash {got}, not {want}"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), size, sha256 of every file there, hidden ones and the manifest left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inside = F.regexp_replace("path", "^.*?" + folder.strip("/").replace(".", r"\.") + "/", "")
    return files.select(inside.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).where(~F.rlike("path", F.lit(r"(^|/)[._][^/]*$|(^|/)MANIFEST[^/]*$")))


# ---- pages of a document -----------------------------------------------------------


def page_fold(pages: DataFrame, by: str, *, most: int, coverage: int = 0, enabled: bool = True) -> DataFrame:
    """What happens to each page in order: native, ocr, deferred (coverage spent), skipped (limit spent).

    pages: by, page_number, readable, blank, force (a first page whose header
    needs recognition).  A page that isn't readable, or is forced, asks for an
    attempt; blank ones use none up.  Whether a page gets one depends on how many
    were made before it: a fold over the document's pages, one row each.
    """
    page = F.struct("page_number", "readable", "blank", "force")
    ordered = pages.groupBy(by).agg(F.array_sort(F.collect_list(page)).alias("ps"))
    kind = "array<struct<page_number:int,decision:string,attempt:int>>"

    def step(s: Column, p: Column) -> Column:
        wants = ~p["readable"] | p["force"]
        covered = (F.lit(coverage) <= 0) | (s["made"] < coverage)
        may = F.lit(enabled) & (s["made"] < most) & covered
        tries = wants & may & ~p["blank"]
        decision = F.when(wants & p["blank"] & may, "blank").when(tries, "ocr").when(wants & F.lit(enabled) & (s["made"] >= most), "skipped").when(wants & F.lit(enabled) & ~covered, "deferred").when(p["readable"], "native").otherwise("unreadable")
        made = s["made"] + tries.cast("int")
        row = F.struct(p["page_number"].cast("int").alias("page_number"), decision.alias("decision"), F.when(tries, made).cast("int").alias("attempt"))
        return F.struct(made.alias("made"), F.array_append(s["out"], row).alias("out"))

    start = F.struct(F.lit(0).alias("made"), F.array().cast(kind).alias("out"))
    return ordered.select(by, F.explode(F.aggregate("ps", start, step, lambda s: s["out"])).alias("p")).select(by, "p.*")


def document_pages(decided: DataFrame, by: str) -> DataFrame:
    """The page sets of a document: recognised, attempted, skipped, deferred and unreadable page numbers."""
    of = lambda *kinds: F.array_sort(F.collect_list(F.when(F.col("decision").isin(*kinds), F.col("page_number"))))
    return decided.groupBy(by).agg(of("ocr").alias("ocr_pages"), F.array_sort(F.collect_list(F.when(F.col("attempt").isNotNull(), F.col("page_number")))).alias("attempted_pages"), of("skipped").alias("skipped_pages"), of("deferred").alias("deferred_pages"), of("unreadable").alias("unreadable_pages"))


def terminal(state: DataFrame) -> DataFrame:
    """Rows that no run will look at again."""
    return state.where(F.col("status").isin(*TERMINAL) | (F.coalesce("is_active", F.lit(0)) == 0))


def top_facets(hits: DataFrame, k: int = 32) -> DataFrame:
    """category, chunks, n (URLs): the k commonest categories (the search engine's limit), ties by name."""
    counts = hits.where("content_category IS NOT NULL").groupBy(F.col("content_category").alias("category")).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("url").alias("n"))
    return counts.orderBy(F.desc("chunks"), "category").limit(k)


def missing_values(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """column, present, missing: control queries over columns, null and blank alike."""
    flags = [F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").alias(c) for c in columns]
    one = rows.agg(F.count(F.lit(1)).alias("all"), *flags)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("present"), (F.col("all") - F.col(c)).alias("missing")) for c in columns])
    return one.select(F.explode(pairs).alias("p")).select("p.*")


