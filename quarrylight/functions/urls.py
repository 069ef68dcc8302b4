"""URL policy: canonical forms, keys, classes and the three category rules, as column expressions."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import text_or_empty

# Suffixes, paths and parameters of the URL policy.
PAGE_SUFFIXES = ("", ".php", ".html", ".htm", ".asp", ".aspx", ".cgi")
FILE_SUFFIXES = (".csv", ".docx", ".odt", ".ods", ".pdf", ".rtf", ".txt", ".xlsx")
ARCHIVE_SUFFIXES = (".7z", ".gz", ".rar", ".tar", ".tgz", ".zip")
UNSUPPORTED_OFFICE = (".doc", ".xls")
OFFICE_SUFFIXES = (".doc", ".docx", ".odt", ".ods", ".rtf", ".xls", ".xlsx")
LEGACY_DETAIL_PATHS = ("/content/detail.php", "/contents/detail.php")
IGNORED_PREFIXES = ("/bitrix/", "/local/")
IGNORED_PARAMETERS = ("gclid", "yclid", "fbclid", "_openstat")
ALLOWED_PARAMETERS = ("element_id", "section_id", "id", "year", "page")
CONTENT_TYPES = {
    ".csv": "text/csv", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".odt": "application/vnd.oasis.opendocument.text", ".ods": "application/vnd.oasis.opendocument.spreadsheet",
    ".pdf": "application/pdf", ".rtf": "application/rtf", ".txt": "text/plain", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}


def _part(url: Column, group: int) -> Column:
    """1 scheme, 2 host with port, 3 path, 4 query, of an absolute URL or a path."""
    return F.regexp_extract(text_or_empty(url), r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(_part(url, 2), "^.*@", ""), ":[0-9]*$", ""))


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def host_allowed(url: Column, allowed: str) -> Column:
    """The host or a subdomain of it, by http or https."""
    return scheme(url).isin("http", "https") & ((host(url) == allowed.lower()) | F.endswith(host(url), F.lit("." + allowed.lower())))


def content_type(c: Column) -> Column:
    return F.lower(F.trim(F.substring_index(text_or_empty(c), ";", 1)))


def is_pdf_response(kind: Column, url: Column, disposition: Column) -> Column:
    return F.contains(content_type(kind), F.lit("application/pdf")) | F.endswith(F.lower(path(url)), F.lit(".pdf")) | F.contains(F.lower(text_or_empty(disposition)), F.lit(".pdf"))


def suffix(p: Column) -> Column:
    """Lower-case suffix of a path's last name; a leading or final dot makes none."""
    return F.regexp_extract(F.lower(p), r"[^/.][^/]*?(\.[^/.]+)/*$", 1)


def is_archive(url: Column) -> Column:
    return suffix(F.try_url_decode(path(url))).isin(*ARCHIVE_SUFFIXES)


def is_unsupported_office(url: Column) -> Column:
    return suffix(F.try_url_decode(path(url))).isin(*UNSUPPORTED_OFFICE)


def parameters(url: Column) -> Column:
    """array<struct<key, value>>, not decoded; parameters without a value have an empty one."""
    items = F.filter(F.split(query(url), "&"), lambda x: x != "")
    return F.transform(items, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(F.contains(x, F.lit("=")), F.substring(x, F.length(F.substring_index(x, "=", 1)) + 2, F.length(x))).otherwise("").alias("value")))


def is_legacy_detail(url: Column) -> Column:
    p = F.lower(F.regexp_replace(path(url), "/+$", ""))
    return p.isin(*LEGACY_DETAIL_PATHS) & F.exists(parameters(url), lambda x: F.lower(x["key"]) == "id")


def is_detail(url: Column) -> Column:
    """A page of one item: an element id, a known item path, or a last number of 10000 or more."""
    p = F.lower(F.regexp_replace(path(url), "/+$", ""))
    number = F.regexp_extract(p, r"/0*(\d*)$", 1)
    big = (F.length(number) > 5) | ((F.length(number) == 5) & (number >= "10000"))
    return F.exists(parameters(url), lambda x: F.lower(x["key"]) == "element_id") | F.rlike(p, F.lit(r"/press-sluzhba/novosti/\d+/\d+$")) | F.rlike(p, F.lit(r"/press-sluzhba/obyavleniya/\d+$")) | big


def is_page_parameter(key: Column) -> Column:
    return F.startswith(F.lower(key), F.lit("pagen_")) | (F.lower(key) == "page")


def is_pagination(url: Column) -> Column:
    return F.exists(parameters(url), lambda x: is_page_parameter(x["key"]))


def page_number(url: Column) -> Column:
    """The largest page number; null if one isn't a number or there is none."""
    values = F.transform(F.filter(parameters(url), lambda x: is_page_parameter(x["key"])), lambda x: x["value"])
    return F.when(F.forall(values, lambda v: F.rlike(v, F.lit(r"^\d+$"))), F.array_max(F.transform(values, lambda v: v.try_cast("bigint"))))


def dedupe_key(url: Column) -> Column:
    """Path without final slashes and query, lower case; scheme and host don't count."""
    p = F.regexp_replace(path(url), "/+$", "")
    return F.struct(F.lower(F.when(p == "", "/").otherwise(p)).alias("path"), F.lower(query(url)).alias("query"))


def newest_number(url: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(path(url), F.lit(r"\d{1,18}"), 0), lambda n: n.cast("bigint"))), F.lit(0).cast("bigint"))


def url_class(url: Column) -> Column:
    p = F.lower(F.regexp_replace(path(url), "/+$", ""))
    found = F.when(suffix(p) == ".pdf", "pdf").when(F.rlike(p, F.lit(r"/press-sluzhba/novosti/\d+/\d+$")), "novosti").when(F.rlike(p, F.lit(r"/press-sluzhba/obyavleniya/\d+$")), "obyavleniya")
    return found.when(F.rlike(p, F.lit(r"/antikor-ekspert/\d+$")), "antikor-ekspert").when(is_detail(url), "drugaya-kartochka").otherwise("razdel-ili-stranitsa")


def selection_priority(url: Column, source: Column) -> Column:
    """Sort key: HTML first, then item pages, pages and PDFs, then the newest number."""
    kind = url_class(url)
    tier = F.when(kind == "pdf", 2).when(kind == "razdel-ili-stranitsa", 1).otherwise(0)
    return F.struct(F.when(source == "html", 0).otherwise(1).alias("source_tier"), tier.alias("tier"), (-newest_number(url)).alias("newest"), url.alias("url"))


def format_bucket(url: Column, doc_type: Column) -> Column:
    """html, pdf, office, text, archive or other: by type and suffix."""
    name = F.substring_index(F.regexp_replace(F.lower(F.substring_index(text_or_empty(url), "?", 1)), "/+$", ""), "/", -1)
    s = F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")
    kind = F.lower(text_or_empty(doc_type))
    found = F.when((kind == "pdf") | (s == ".pdf"), "pdf").when(s.isin(*OFFICE_SUFFIXES), "office").when(s.isin(".csv", ".txt"), "text").when(s.isin(*ARCHIVE_SUFFIXES), "archive")
    return found.when((kind == "page") | s.isin(*PAGE_SUFFIXES), "html").otherwise("other")


def canonical_sitemap_url(url: Column, allowed: str) -> Column:
    """https, known host without www, single slashes, no tracking parameters, sorted query, no fragment; else null.

    Parameters keep their own percent encoding.
    """
    p = F.regexp_replace(F.when(path(url) == "", "/").otherwise(path(url)), "/{2,}", "/")
    s = suffix(p)
    fine = host_allowed(F.trim(url), allowed) & ~is_legacy_detail(url) & s.isin(*PAGE_SUFFIXES, *FILE_SUFFIXES)
    for prefix in IGNORED_PREFIXES:
        fine = fine & ~F.startswith(F.lower(p), F.lit(prefix))
    kept = F.filter(parameters(url), lambda x: ~F.startswith(F.lower(x["key"]), F.lit("utm_")) & ~F.lower(x["key"]).isin(*IGNORED_PARAMETERS))
    q = F.array_join(F.transform(F.array_sort(kept), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "&")
    h = F.when(host(url) == "www." + allowed, F.lit(allowed)).otherwise(host(url))
    return F.when(fine, F.concat(F.lit("https://"), h, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def _tidy(p: str) -> str:
    parts: list[str] = []
    for part in p.split("/"):
        if part == "..":
            del parts[-1:]
        elif part not in ("", "."):
            parts.append(part)
    return "/" + "/".join(parts) + ("/" if parts and p.endswith("/") else "")


def canonical_html_url(allowed: str):
    """A pandas UDF (link, base) for links in pages: resolved, tidied, allowed parameters only; else null."""

    def one(raw: str | None, base: str | None) -> str | None:
        raw = (raw or "").strip()
        if not raw or raw.startswith("#") or raw.lower().startswith(("tel:", "mailto:", "javascript:", "data:")):
            return None
        try:
            u = urlsplit(urljoin(base or f"https://{allowed}/", raw))
            h = (u.hostname or "").lower()
        except ValueError:
            return None
        p = _tidy(u.path)
        low, items = p.lower(), parse_qsl(u.query, keep_blank_values=True)
        name = low.rstrip("/").rsplit("/", 1)[-1]
        dot = name.rfind(".")
        end = name[dot:] if 0 < dot < len(name) - 1 else ""
        keys = {k.lower() for k, _ in items}
        if u.scheme.lower() not in ("http", "https") or h not in (allowed, "www." + allowed) or low.startswith(IGNORED_PREFIXES) or end not in PAGE_SUFFIXES + FILE_SUFFIXES:
            return None
        if low.rstrip("/") in LEGACY_DETAIL_PATHS and "id" in keys or low.startswith(("/http:/", "/https:/", "/ftp:/")) or any(f"/{s}:" in low for s in ("tel", "mailto", "javascript", "data")):
            return None
        parts = low.rstrip("/").split("/")
        last = parts[-1]
        item = "element_id" in keys or last.isdecimal() and (int(last) >= 10_000 or parts[-3:-2] and parts[-4:-2] == ["press-sluzhba", "novosti"] and parts[-2].isdecimal() or parts[-3:-1] == ["press-sluzhba", "obyavleniya"])
        page = lambda k: k.startswith("pagen_") or k == "page"
        kept = [(k, v) for k, v in items if (page(k.lower()) and not item) or (not page(k.lower()) and k.lower() in ALLOWED_PARAMETERS)]
        return urlunsplit(("https", allowed, p, urlencode(sorted(kept, key=lambda x: (x[0].lower(), x[1]))), ""))

    @F.pandas_udf(T.StringType())
    def canonical(links: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(links, bases)], dtype="object")

    return canonical


def crawl_category(url: Column) -> Column:
    p, q = F.lower(path(url)), F.lower(query(url))
    has = lambda s: F.contains(p, F.lit(s))
    c = F.when(has("normativno-pravovyye-akty") & F.contains(q, F.lit("element_id=")), "legal").when(has("/press-sluzhba/novosti/"), "news").when(has("/press-sluzhba/obyavleniya/"), "announcement")
    c = c.when(has("/press-sluzhba/mediagalereya") | has("/press-sluzhba/mediagalareya"), "media").when(has("/upload/"), "file").when(has("/press-sluzhba/"), "press").when(has("/gorodskaya-vlast/"), "city_authority")
    return c.when(has("/zhizn-goroda/"), "city_life").when(has("/afisha-goroda/") | has("/kalendar-meropriyatiy/"), "events").when(has("/gorod/"), "city").otherwise("page")


def display_category(url: Column) -> Column:
    u = F.lower(text_or_empty(url))
    has = lambda s: F.contains(u, F.lit(s))
    c = F.when(has("/press-sluzhba/novosti/"), "news").when(has("/gorodskaya-vlast/normativno-pravovyye-akty/"), "legal").when(has("/press-sluzhba/obyavleniya/"), "announcement")
    c = c.when(has("/press-sluzhba/mediagalereya") | has("/press-sluzhba/mediagalareya"), "media").when(has("/press-sluzhba/"), "press").when(has("/gorodskaya-vlast/"), "city_authority").when(has("/zhizn-goroda/"), "city_life")
    return c.when(has("/afisha-goroda/") | has("/kalendar-meropriyatiy/"), "events").when(has("/gorod/"), "city").when(has("/upload/"), "file").when(has("/content/") | has("/contents/") | has("/strucrure_sochi/"), "legacy").otherwise("page")


def reindex_category(url: Column) -> Column:
    """By the path's beginning, case kept; null URLs have none."""
    rest = F.regexp_replace(url, "^.*?://", "")
    p = F.when(F.contains(rest, F.lit("/")), F.regexp_extract(rest, "(/.*)$", 1)).otherwise("/")
    at = lambda *s: F.rlike(p, F.lit("^(" + "|".join(s) + ")"))
    c = F.when(url.isNull(), F.lit(None)).when(at("/press-sluzhba/novosti/"), "news").when(at("/gorodskaya-vlast/normativno-pravovyye-akty/"), "legal").when(at("/press-sluzhba/obyavleniya/"), "announcement").when(at("/press-sluzhba/mediagalereya", "/press-sluzhba/mediagalareya"), "media")
    c = c.when(at("/upload/"), "file").when(at("/press-sluzhba/"), "press").when(at("/gorodskaya-vlast/"), "city_authority").when(at("/zhizn-goroda/"), "city_life").when(at("/gorod/"), "city")
    return c.when(at("/afisha-goroda/", "/kalendar-meropriyatiy/"), "events").when(at("/content/", "/contents/", "/strucrure_sochi/"), "legacy").otherwise("other")


# Sections of which another page is fetched.
FETCH_INSTEAD = {"/press-sluzhba/": "/press-sluzhba/novosti/", "/gorod/": "/gorod/obshchaya-informatsiya/gorod-sobytiye/", "/gorodskaya-vlast/": "/gorodskaya-vlast/administratsiya-goroda/structure/"}


def fetch_url(url: Column, allowed: str) -> Column:
    """What is requested for a page: https, the canonical host, and for three sections another path."""
    p = F.regexp_replace(F.when(path(url) == "", "/").otherwise(path(url)), "/{2,}", "/")
    other = F.try_element_at(F.create_map(*[F.lit(x) for kv in FETCH_INSTEAD.items() for x in kv]), p)
    q = query(url)
    return F.concat(F.lit(f"https://{allowed}"), F.coalesce(other, p), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def request_url(doc_type: Column, url: Column, file_url: Column, page_url: Column) -> Column:
    """Files are fetched by their file URL; else the row's own URL, or what there is."""
    some = lambda c: F.nullif(F.trim(text_or_empty(c)), F.lit(""))
    return F.coalesce(F.when(F.lower(text_or_empty(doc_type)).isin("pdf", "file"), some(file_url)), some(url), some(file_url), some(page_url), F.lit(""))


def suspicious(url: Column, allowed: str) -> Column:
    """Why a candidate looks wrong; null if it doesn't."""
    low, p = F.lower(text_or_empty(url)), F.lower(path(url))
    odd = F.lit(False)
    for s in ("/./", "/../", "tel:", "mailto:", "javascript:"):
        odd = odd | F.contains(low, F.lit(s))
    found = F.when(scheme(url) != "https", "неверная схема").when(host(url) != allowed, "чужой хост").when(odd, "служебный или ненормализованный путь")
    return found.when(F.rlike(p, F.lit("^/(https?|ftp):/")), "вложенная схема в пути").when(is_pagination(url), "пагинация попала в кандидаты")


def publication_kind(url: Column) -> Column:
    """news or announcement for their item pages; else null."""
    p = F.lower(path(url))
    return F.when(F.rlike(p, F.lit(r"^/press-sluzhba/novosti/\d+/\d+/?$")), "news").when(F.rlike(p, F.lit(r"^/press-sluzhba/obyavleniya/\d+/?$")), "announcement")


def attachment_url(url: Column, allowed: str) -> Column:
    """An absolute link to an attachment: http, no www, no fragment; null for other hosts."""
    h = F.when(host(url) == "www." + allowed, F.lit(allowed)).otherwise(host(url))
    p, q = F.when(path(url) == "", "/").otherwise(path(url)), query(url)
    return F.when(host_allowed(F.trim(url), allowed), F.concat(F.lit("http://"), h, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))
