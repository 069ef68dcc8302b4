"""Titles and readable fragments: which of several candidates is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .repair import document_number
from .text import DOCUMENT_MARKERS, GENERIC_TITLES, compact, first_text, format_date, is_generic_title, let, strip_tags, technical_name, text_or_empty, title_from_text, truncate
from .urls import path

# Where the navigation of the site begins in a page's text.
NAVIGATION = (
    " Новости Объявления СМИ о Сочи", " Объявления СМИ о Сочи", " СМИ о Сочи Конкурсы и инициативы", " О городе Общая информация Туризм",
    " Городская власть Администрация города Деятельность", " Тематика: Архив", " Перейти к обсуждению", " Действия: Поделиться",
)
UNTITLED, PDF_TITLE = "Без названия", "PDF-документ"


def act_title(kind: Column, number: Column, date: Column) -> Column:
    """'Kind № number от date' where there is a kind and one of the others; else null."""
    k, n, d = compact(kind), compact(number), compact(date)
    parts = F.concat_ws(" ", k, F.when(n != "", F.concat(F.lit("№ "), n)), F.when(d != "", F.concat(F.lit("от "), d)))
    return F.when((k != "") & ((n != "") | (d != "")), parts)


def shown_title(title: Column, attachment: Column, kind: Column, number: Column, date: Column, text: Column, section: Column, garbled: Column) -> Column:
    """Attachment, page title, act, a title out of the text, section, then whatever there is."""
    t, a = F.trim(text_or_empty(title)), F.trim(text_or_empty(attachment))
    derived = F.nullif(F.when(garbled, F.lit("")).otherwise(title_from_text(text)), F.lit(""))
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(
        F.when(~is_generic_title(a), truncate(a, 240)), F.when(~is_generic_title(t), truncate(t, 240)), truncate_or_null(act_title(kind, number, format_date(date)), 240), derived,
        some(truncate(F.trim(text_or_empty(section)), 240)), some(truncate(t, 240)), some(truncate(a, 240)), F.lit(UNTITLED),
    )


def truncate_or_null(c: Column, limit: int) -> Column:
    return F.when(c.isNotNull(), truncate(c, limit))


def useful_file_title(c: Column, generic: tuple[str, ...] = ()) -> Column:
    """Long enough, not made by a machine, not generic unless it names an act."""

    def judge(x: Column) -> Column:
        low = F.lower(x)
        marked, common = F.lit(False), F.lit(False)
        for m in DOCUMENT_MARKERS:
            marked = marked | F.contains(low, F.lit(m.lower()))
        for g in generic:
            common = common | F.contains(low, F.lit(g))
        return (F.length(x) >= 4) & ~low.isin(*GENERIC_TITLES) & ~technical_name(x) & ~(common & ~marked)

    return let(compact(c), judge)


def first_pages_title(pages: Column) -> Column:
    """From the first act marker in the first three pages (array of texts), to the end of a quote or sentence; empty without one."""

    def of_part(part: Column) -> Column:
        ends = [F.when(F.locate(s, part, 71) > 0, F.locate(s, part, 71) + len(s.strip()) - 1) for s in ("»", ". ", "; ")]
        return F.trim(F.substring(F.substring(part, F.lit(1), F.coalesce(*ends, F.lit(300))), 1, 240))

    def of_text(x: Column) -> Column:
        start = let(F.lower(x), lambda low: F.array_min(F.filter(F.array(*[F.locate(m.lower(), low) for m in DOCUMENT_MARKERS]), lambda p: p > 0)))
        return let(start, lambda at: F.when(at.isNull(), F.lit("")).otherwise(let(F.substring(x, at, F.lit(300)), of_part)))

    return let(compact(F.array_join(F.slice(pages, 1, 3), " ")), of_text)


def indexed_title(doc_type: Column, title: Column, attachment: Column, kind: Column, number: Column, date: Column, pages: Column) -> Column:
    """The title that the index gets: pages keep theirs, files take the most telling one."""
    t, a = F.trim(text_or_empty(title)), F.trim(text_or_empty(attachment))
    files = F.coalesce(F.when(useful_file_title(a), a), act_title(kind, number, date), F.when(useful_file_title(t), t), F.nullif(first_pages_title(pages), F.lit("")), F.nullif(a, F.lit("")), F.nullif(t, F.lit("")), F.lit(PDF_TITLE))
    return F.when(doc_type.isin("pdf", "file"), files).otherwise(text_or_empty(title))


def file_name(url: Column) -> Column:
    """The decoded last name of a URL's path."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(F.regexp_extract(path(url), "([^/]*)/*$", 1), r"\+", "%2B")), F.lit(""))


def url_title(url: Column) -> Column:
    return F.when(technical_name(file_name(url)), "").otherwise(file_name(url))


def clean_site_text(c: Column, limit: int, prefixes: tuple[str, ...] = (), tags: bool = True) -> Column:
    """Without tags (unless there are none), the site's own prefix and what follows the first navigation marker."""

    def of_text(x: Column) -> Column:
        places = F.filter(F.array(*[F.locate(m, x) for m in NAVIGATION]), lambda p: p > 0)
        return let(F.array_min(places), lambda at: F.when(at.isNull(), x).otherwise(F.trim(F.substring(x, F.lit(1), at - 1))))

    def bare(x: Column) -> Column:
        out = x
        for p in prefixes[::-1]:
            out = F.when(F.startswith(x, F.lit(p)), F.trim(F.substring(x, len(p) + 1, 1_000_000))).otherwise(out)
        return out

    return truncate(let(let(strip_tags(c) if tags else compact(c), bare), of_text), limit)


def restore_start(snippet: Column, title: Column) -> Column:
    """A snippet that lost up to 24 first characters of the title gets them back."""

    def of(x: Column) -> Column:
        s, t = x["s"], x["t"]
        lost = F.filter(F.sequence(F.lit(1), F.lit(24)), lambda k: (k < F.length(t)) & F.startswith(s, F.substring(t, k + 1, F.length(t))))
        fine = (s == "") | (t == "") | F.startswith(s, t)
        return F.when(fine, s).otherwise(let(F.try_element_at(lost, F.lit(1)), lambda k: F.when(k.isNull(), s).otherwise(F.concat(F.substring(t, F.lit(1), k), s))))

    return let(F.struct(snippet.alias("s"), title.alias("t")), of)


def drop_title(snippet: Column, title: Column) -> Column:
    """A snippet that begins with the title goes on after it, or after its repetition, if enough is left."""
    bare = lambda c: F.regexp_replace(c, r"^[ \-–—:;,.\n\t]+", "")

    def of(x: Column) -> Column:
        s, t = x["s"], x["t"]

        def after(rest: Column) -> Column:
            again = F.call_function("locate", t, rest)
            tail = bare(F.substring(rest, again + F.length(t), F.length(rest)))
            return F.when(again.between(1, 101) & (F.length(tail) >= 40), tail).when(F.length(rest) >= 80, rest).otherwise(s)

        return F.when((s == "") | (t == "") | ~F.startswith(s, t), s).otherwise(let(bare(F.substring(s, F.length(t) + 1, F.length(s))), after))

    return let(F.struct(snippet.alias("s"), title.alias("t")), of)


def result_snippet(snippet: Column, text: Column, title: Column, tags: bool = True) -> Column:
    """The snippet cleaned; the beginning of the text if fewer than 40 characters are left."""
    one = lambda c, n: clean_site_text(drop_title(restore_start(clean_site_text(c, n, tags=tags), title), title), 520, tags=False)
    both = F.struct(one(snippet, 650).alias("a"), one(text, 520).alias("b"))
    return let(both, lambda x: F.when(F.length(x["a"]) >= 40, x["a"]).otherwise(x["b"]))


def source_name(source: Column, host: Column, default: str) -> Column:
    return first_text(source, host, F.lit(default))


def canonical_number_or_null(c: Column) -> Column:
    return F.nullif(document_number(c), F.lit(""))
