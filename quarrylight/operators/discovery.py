"""Discovery: the frontier search over links, and the union of what sitemaps and pages tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import urls

from .checkpoints import checkpoint


def reachable(seeds: DataFrame, edges: DataFrame, depth: int, follow=None, *, most_pages: int | None = None, most_paged: int | None = None, most_found: int | None = None) -> DataFrame:
    """url, depth of all that can be reached from seeds (url) over edges (src, dst) in `depth` steps, by frontier joins.

    `follow` is a predicate on URLs that are looked into; item pages are never
    looked into, only recorded.  The three limits are the crawl's: pages looked
    into, pagination pages among them, URLs found; within a step the smaller URL
    comes first.  Frontier and findings are checkpointed, so that a step's plan
    holds one join whatever the depth.
    """
    seen = checkpoint(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    frontier, pages, paged, found = seen, 0, 0, seen.count()
    for step in range(1, depth + 1):
        source = frontier if follow is None else frontier.where(follow(F.col("url")))
        source = source.where(~F.coalesce(urls.is_detail(F.col("url")), F.lit(False)))
        if most_paged is not None:
            listed = source.where(urls.is_pagination(F.col("url"))).orderBy("url").limit(max(0, most_paged - paged))
            source = checkpoint(source.where(~F.coalesce(urls.is_pagination(F.col("url")), F.lit(False))).unionByName(listed))
            paged += source.where(urls.is_pagination(F.col("url"))).count()
        if most_pages is not None:
            source = checkpoint(source.orderBy("url").limit(max(0, most_pages - pages)))
            pages += source.count()
        new = edges.join(source.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        frontier = new.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(step))
        if most_found is not None:
            frontier = frontier.orderBy("url").limit(max(0, most_found - found))
        frontier = checkpoint(frontier)
        n = frontier.count()
        found += n
        seen = checkpoint(seen.unionByName(frontier))
        if not n:
            break
    return seen


def candidates(sitemap: DataFrame, html: DataFrame) -> DataFrame:
    """Both sources (url, source) with one row for each key; what a page links to wins over the sitemap."""
    both = sitemap.unionByName(html, allowMissingColumns=True)
    keyed = both.select(F.struct(*both.columns).alias("row"), urls.dedupe_key(F.col("url")).alias("k"))
    order = Window.partitionBy("k").orderBy(F.when(F.col("row.source") == "html", 0).otherwise(1), "row.url")
    return keyed.withColumn("n", F.row_number().over(order)).where("n = 1").select("row.*")


def new_candidates(found: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """What isn't known under its key yet, by priority, at most `limit` rows (a limit of the crawl)."""
    keyed = found.withColumn("_k", urls.dedupe_key(F.col("url")))
    fresh = keyed.join(known.select(urls.dedupe_key(F.col("url")).alias("_k")).distinct(), "_k", "left_anti").drop("_k")
    return fresh.orderBy(urls.selection_priority(F.col("url"), F.col("source"))).limit(limit)


def describe(found: DataFrame, source: str) -> DataFrame:
    """Queue rows for URLs: page or file, type, content type."""
    s = urls.suffix(urls.path(F.col("url")))
    is_file = s.isin(*urls.FILE_SUFFIXES)
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in urls.CONTENT_TYPES.items() for x in kv]), s)
    return found.select("url", F.when(~is_file, F.col("url")).alias("page_url"), F.when(is_file, F.col("url")).alias("file_url"), F.lit(source).alias("source"), F.when(s == ".pdf", "pdf").when(is_file, "file").otherwise("page").alias("doc_type"), kind.alias("content_type"))


def sitemap_pages(start: list[str], fetch, most_maps: int = 200, most_pages: int = 100_000) -> tuple[dict[str, str | None], list[str]]:
    """(page: lastmod, errors) of sitemaps and those they name, each read once; the two limits are the crawl's.

    `fetch` gives the bytes of a sitemap's URL; what it raises is an error of
    that sitemap alone.  A driver-side walk: it follows a few small files.
    """
    from quarrylight.sources.formats import sitemap

    todo, seen, pages, errors = list(start), set(start), {}, []
    read = 0
    while todo and read < most_maps and len(pages) < most_pages:
        url = todo.pop(0)
        read += 1
        try:
            maps, found = sitemap(fetch(url))
        except Exception as e:
            errors.append(f"{url}: {e}")
            continue
        todo += [m for m in maps if m not in seen]
        seen.update(maps)
        for page, modified in found[: most_pages - len(pages)]:
            pages.setdefault(page, modified)
    return pages, errors
