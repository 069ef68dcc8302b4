"""What a user sees: snippets, the extractive answer, and the CSV export."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.functions.analysis import lemma
from quarrylight.functions.batches import parts
from quarrylight.functions.readability import readability
from quarrylight.functions.text import QUESTION_WORDS, compact, csv_guard, is_generic_title, title_from_text, truncate
from quarrylight.functions.titles import clean_site_text, result_snippet
from quarrylight.functions.urls import display_category

from .search import parse, terms_of

_BEFORE, _AFTER, _SLACK = 170, 280, 150
NOTICE = "Краткий ответ составлен автоматически из найденных фрагментов. Для точной формулировки и применения информации откройте первоисточник."
NOTHING = "В проиндексированных материалах подходящая информация не найдена."


def _short(text: str, limit: int) -> str:
    return text if len(text) <= limit else text[:limit].rstrip(" ,.;:-") + "…"


def snippet_of(text: str, query: str, limit: int = 520) -> str:
    """The surroundings of the whole query, else of its longest word that occurs, cut at sentences."""
    text, query = " ".join(text.split()), " ".join(query.split())
    low = text.lower()
    words = [w.lower() for w in re.findall(r"[0-9A-Za-zА-Яа-яЁё№/-]+", query)]
    useful = [w for w in words if w not in QUESTION_WORDS]
    useful = useful if len(useful) >= 2 else words
    tries = [query.lower(), *sorted({w for w in useful if len(w) >= 3}, key=lambda w: (-len(w), w))]
    at, size = next(((p, len(t)) for t in tries if t and (p := low.find(t)) >= 0), (-1, 0))
    if at < 0:
        return _short(text, limit)
    left, right = max(0, at - _BEFORE), min(len(text), at + size + _AFTER)
    start = max([left, *(p + len(s) for s in (". ", "! ", "? ", "; ", "» ") if (p := text.rfind(s, left, at)) >= 0)])
    end = min([p + 1 for s in (". ", "! ", "? ", "; ") if (p := text.find(s, at + size, min(len(text), right + _SLACK))) >= 0], default=right)
    return _short(("…" if start > 0 else "") + text[start:end].strip(" ,.;:-") + ("…" if end < len(text) else ""), limit)


def snippets(items: DataFrame, query: str, limit: int = 520) -> DataFrame:
    """items with a snippet of `text` for the query; a row at a time inside Arrow batches, after the page was cut."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts(batch, batch.schema.get_field_index("text"))):
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([snippet_of(t or "", query, limit) for t in texts], pa.string())], [*part.schema.names, "snippet"])

    return items.mapInArrow(run, T.StructType([*items.schema.fields, T.StructField("snippet", T.StringType())]))


def answer(items: DataFrame, k: int = 5) -> DataFrame:
    """One row: answer, notice, source_count and sources, from the k best items (score, url, title, snippet)."""
    top = items.orderBy(F.desc("score"), "url").limit(k)
    low = F.lower(compact(F.col("snippet")))
    parts = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "url", "title", "snippet", low.alias("low"), truncate(F.col("snippet"), 340).alias("short")))).alias("p"))
    fresh = F.filter("p", lambda x, i: (x["snippet"] != "") & ~F.exists(F.slice("p", 1, F.greatest(i, F.lit(0))), lambda y: y["low"] == x["low"]))
    said = F.concat(F.lit("По наиболее релевантным материалам:\n\n"), F.array_join(F.transform(fresh, lambda x: F.concat(F.lit("• "), x["short"])), "\n\n"))
    text = F.when(F.size("p") == 0, NOTHING).when(F.size(fresh) == 0, "Материалы найдены, но подходящие текстовые фрагменты отсутствуют.").otherwise(said)
    return parts.select(text.alias("answer"), F.lit(NOTICE).alias("notice"), F.size("p").alias("source_count"), F.transform("p", lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title"))).alias("sources"))


def snippet_query(raw: str) -> str:
    """What snippets look for: quoted phrases and plain words, without what is excluded."""
    q = parse(raw)
    return " ".join([*q.phrases, *([q.text] if q.text else [])]).strip() or " ".join((raw or "").split())


def highlighted(text: str, lemmas: frozenset[str], size: int = 320, most: int = 2, no_match: int = 220) -> list[str]:
    """Up to `most` stretches of about `size` characters with the query's lemmas in <mark>, the richest first; the text's beginning if there is none.

    The text is escaped; a stretch begins and ends at a word.
    """
    words = [(m.start(), m.end(), lemma(m[0].translate(_YO).lower())) for m in re.finditer(r"\w+", text)]
    hits = [w for w in words if w[2] in lemmas]
    if not hits:
        cut = text if len(text) <= no_match else text[:no_match].rsplit(" ", 1)[0]
        return [html.escape(cut, quote=False)] if cut else []
    found, at = [], -1
    for start, *_ in hits:
        if start < at:
            continue
        begin = max((w[0] for w in words if w[0] <= max(0, start - size // 4)), default=0)
        end = max((w[1] for w in words if w[1] <= begin + size), default=begin + size)
        inside = [h for h in hits if begin <= h[0] and h[1] <= end]
        found.append((begin, end, inside))
        at = end
    best = sorted(found, key=lambda f: (-len({h[2] for h in f[2]}), -len(f[2]), f[0]))[:most]
    out = []
    for begin, end, inside in best:
        parts, p = [], begin
        for a, b, _ in inside:
            parts += [html.escape(text[p:a], quote=False), "<mark>", html.escape(text[a:b], quote=False), "</mark>"]
            p = b
        out.append("".join([*parts, html.escape(text[p:end], quote=False)]))
    return out


_YO = str.maketrans("ёЁ", "еЕ")


def highlight(items: DataFrame, raw: str) -> DataFrame:
    """items with `highlights` of their text: of the page that was cut, a few rows."""
    lemmas = frozenset(terms_of(snippet_query(raw), "lemma"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([highlighted(t or "", lemmas) for t in texts], pa.list_(pa.string()))], [*batch.schema.names, "highlights"])

    return items.mapInArrow(run, T.StructType([*items.schema.fields, T.StructField("highlights", T.ArrayType(T.StringType()))]))


# What a result says of a PDF without readable text, the categories that show their label, the fields of a result.
GARBLED_PDF = "Текст этого PDF требует повторного распознавания. Документ можно открыть по ссылке."
LABELLED = ("news", "announcement", "media", "press", "events", "file", "legacy")
SOURCE = ("url", "page_url", "file_url", "parent_url", "title", "section", "site_section", "attachment_title", "text", "doc_type", "content_category", "page_number", "chunk_number", "published_at", "sort_date", "document_number", "document_number_normalized", "document_date", "document_kind", "is_attachment", "text_extraction", "ocr_used")
KEPT = ("page_url", "file_url", "doc_type", "document_number", "document_date", "published_at", "sort_date", "document_kind", "parent_url", "attachment_title", "is_attachment", "content_type", "source", "page_number", "chunk_number", "updated_at", "fetched_at", "extraction_version", "text_extraction", "source_page_count", "ocr_page_count", "ocr_attempted_page_count", "ocr_rejected_page_count", "unreadable_page_count")


def projection(hits: DataFrame, fields: tuple[str, ...] = SOURCE) -> DataFrame:
    """The fields that a search returns, and the score; ones that the chunks lack are null."""
    return hits.select(*[(F.col(c) if c in hits.columns else F.lit(None).cast("string")).alias(c) for c in fields], *[c for c in ("chunk_id", "score") if c in hits.columns])


def _stripped(items: DataFrame, columns: list[str]) -> DataFrame:
    """Tags and entities out of some columns of a page of results."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in columns:
                k = batch.schema.get_field_index(c)
                plain = [None if t is None else " ".join(html.unescape(re.sub("<[^>]+>", "", t)).split()) for t in batch.column(k).to_pylist()]
                batch = batch.set_column(k, c, pa.array(plain, pa.string()))
            yield batch

    return items.mapInArrow(run, items.schema)


def results(hits: DataFrame, raw: str) -> DataFrame:
    """A page of hits as results: id, score, title, snippet, section, labels and what is known of the document.

    The page is cut before: snippets, highlights and titles are made for its rows alone.
    """
    known = projection(hits, (*SOURCE, *(c for c in KEPT if c not in SOURCE)))
    row = known.withColumn("chunk_id", F.col("chunk_id").cast("string") if "chunk_id" in hits.columns else F.lit(None).cast("string")).withColumn("score", F.col("score").cast("double") if "score" in hits.columns else F.lit(0.0)).withColumn("text", F.coalesce("text", F.lit("")))
    judged = readability(row.select(F.struct(*row.columns).alias("row"), "text"))
    bad = (F.length(F.trim("text")) >= 80) & (F.col("reason") != "readable")
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(""))
    plain = _stripped(judged.select("row.*", bad.alias("garbled")), ["title", "attachment_title", "section"])
    own = F.when(is_generic_title(F.col("title")), None).otherwise(blank("title"))
    name = clean_site_text(F.coalesce(blank("attachment_title"), own, F.when(~F.col("garbled"), F.nullif(title_from_text(F.col("text")), F.lit(""))), blank("title"), F.lit("")), 360, tags=False)
    # Each pass over the page also keeps the long expressions of the one before from being put into all that follows.
    found = highlight(snippets(plain.withColumn("title", name), snippet_query(raw)), raw).withColumn("shown", F.coalesce(F.get("highlights", F.lit(0)), F.col("snippet"))).drop("highlights", "snippet")
    titled = _stripped(found, ["shown"])
    code = F.coalesce(blank("content_category"), display_category(F.col("url")))
    label = F.coalesce(blank("site_section"), display_category(F.col("url")))
    section = clean_site_text(F.coalesce("section", F.lit("")), 240, tags=False)
    where = F.when(code.isin(*LABELLED) | (section == "") | (section == F.col("title")), label).otherwise(section)
    snippet = F.when((F.col("doc_type") == "pdf") & F.col("garbled"), GARBLED_PDF).otherwise(result_snippet(F.col("shown"), F.col("text"), F.col("title"), tags=False))
    return titled.select(
        F.col("chunk_id").alias("id"), "score", "title", F.lit("").alias("title_html"), "url", snippet.alias("snippet"), F.lit("").alias("snippet_html"), where.alias("section"), code.alias("content_category"), label.alias("content_category_label"), label.alias("site_section"),
        F.coalesce("doc_type", "content_type").alias("document_type"), F.coalesce(F.col("ocr_used").cast("boolean"), F.lit(False)).alias("ocr_used"), *KEPT,
    )


def write_csv(items: DataFrame, folder: str) -> None:
    """Semicolons, CRLF, all values quoted, formulas guarded; each file begins with a byte-order mark, which spreadsheets ask for."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(csv_guard(c), F.lit('"'), F.lit('""')), F.lit('"'))
    head = ";".join('"' + c.replace('"', '""') + '"' for c in items.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(["\ufeff" + head + "\r"])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    lines = items.select(F.concat(F.concat_ws(";", *[quote(F.col(c)) for c in items.columns]), F.lit("\r")).alias("value"))
    lines.mapInArrow(run, "value string").write.mode("overwrite").text(folder)
