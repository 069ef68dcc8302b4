"""Scalar text functions as column expressions (no Python at run time, but for `unescape_html`)."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import mapped

# Act kinds that mark a useful title, months in the genitive, question words, generic titles.
DOCUMENT_MARKERS = ("Постановление", "Распоряжение", "Приказ", "Решение", "Положение", "Извещение", "Объявление", "Протокол")
MONTHS_GENITIVE = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
QUESTION_WORDS = ("что", "кто", "где", "когда", "как", "какой", "какая", "какие", "какое", "кого", "кому", "чем", "ли", "это", "есть", "нужно", "можно", "найти", "найди", "покажи", "расскажи")
GENERIC_TITLES = ("pdf", "файл", "документ")
GENERIC_PARTS = ("скачать документ", "скачать файл")
TECHNICAL_NAME = r"(?i)^(?:(?=[a-z0-9]*\d)[a-z0-9]{24,64}|[0-9a-f]{8}-[0-9a-f-]{20,28})(?:\.[a-z0-9]{1,5})?$"


def let(c: Column, body) -> Column:
    """body(c), with c evaluated once and standing once in the plan, however often body uses it."""
    return F.element_at(F.transform(F.array(c), body), 1)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def compact(c: Column) -> Column:
    """All white space, no-break spaces too, as single blanks; none at the ends; null is empty."""
    return F.trim(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " "))


def normalize_lines(c: Column) -> Column:
    """Unified line ends, single blanks within lines, no empty lines."""
    lines = F.split(F.regexp_replace(text_or_empty(c), r"\r\n?", "\n"), "\n")
    clean = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[ \t\x{A0}\x0B\f]+", " ")))
    return F.array_join(F.filter(clean, lambda x: x != ""), "\n")


@F.arrow_udf(T.StringType())
def unescape_html(values: pa.Array) -> pa.Array:
    """All named and numeric HTML entities."""
    return mapped(values, lambda v: None if v is None else html.unescape(v))


def strip_tags(c: Column) -> Column:
    return compact(unescape_html(F.regexp_replace(text_or_empty(c), "<[^>]+>", "")))


def truncate(c: Column, limit: int = 500) -> Column:
    """At most `limit` characters and an ellipsis; no blanks or punctuation before it."""
    return let(compact(c), lambda x: F.when(F.length(x) <= limit, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, limit), "[ ,.;:-]+$", ""), F.lit("…"))))


def query_words(c: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(r"[0-9A-Za-zА-Яа-яЁё№/-]+"), 0)


def meaningful_query(c: Column) -> Column:
    """A query without question words, if two words or more are left."""
    left = F.filter(query_words(c), lambda w: ~F.lower(w).isin(*QUESTION_WORDS))
    return F.when(F.size(left) >= 2, F.array_join(left, " ")).otherwise(F.trim(text_or_empty(c)))


def technical_name(c: Column) -> Column:
    """File names made by machines: a long run of letters and digits, or a UUID."""
    return F.rlike(F.trim(text_or_empty(c)), F.lit(TECHNICAL_NAME))


def is_generic_title(c: Column, generic_parts: tuple[str, ...] = GENERIC_PARTS) -> Column:

    def judge(t: Column) -> Column:
        marked, generic = F.lit(False), F.lit(False)
        for m in DOCUMENT_MARKERS:
            marked = marked | F.contains(t, F.lit(m.lower()))
        for p in generic_parts:
            generic = generic | F.contains(t, F.lit(p))
        return (t == "") | technical_name(t) | t.isin(*GENERIC_TITLES) | (generic & ~marked)

    return let(F.lower(compact(c)), judge)


def title_from_text(c: Column) -> Column:
    """From the first act marker on, up to a closing quote or the end of a sentence."""

    def of_part(part: Column) -> Column:
        at = lambda s, since, least: F.locate(s, part, since) - 1
        quotes = F.filter(F.array(at("»", 1, 40), at('"', 21, 40)), lambda p: p >= 40)
        sentences = F.filter(F.array(at(". ", 81, 80), at("; ", 81, 80)), lambda p: p >= 80)
        return let(F.coalesce(F.array_min(quotes), F.array_min(sentences)), lambda end: truncate(F.when(end.isNotNull(), F.substring(part, F.lit(1), end + 1)).otherwise(part), 240))

    def of_text(x: Column) -> Column:
        start = let(F.lower(x), lambda low: F.array_min(F.filter(F.array(*[F.locate(m.lower(), low) for m in DOCUMENT_MARKERS]), lambda p: p > 0)))
        return F.when(x == "", F.lit("")).otherwise(let(start, lambda at: F.when(at.isNull(), truncate(x, 180)).otherwise(let(F.substring(x, at, F.lit(320)), of_part))))

    return let(compact(c), of_text)


def format_date(c: Column) -> Column:
    """2024-03-14 as '14 марта 2024'; anything else unchanged."""
    x = compact(c)
    month = F.regexp_extract(x, r"^(\d{4})-(\d{2})-(\d{2})$", 2)
    number = F.when(month != "", month.cast("int"))
    day, year = F.regexp_extract(x, r"^(\d{4})-(\d{2})-(\d{2})$", 3), F.regexp_extract(x, r"^(\d{4})-(\d{2})-(\d{2})$", 1)
    name = F.try_element_at(F.array(*[F.lit(m) for m in MONTHS_GENITIVE]), F.when(number.between(1, 12), number).otherwise(F.lit(13)))
    shown = F.concat_ws(" ", F.when(day != "", day.cast("int")).cast("string"), name, F.when(year != "", year.cast("int")).cast("string"))
    return F.when(number.between(1, 12), shown).otherwise(x)


def first_text(*columns: Column) -> Column:
    """The first that isn't blank, trimmed; else empty."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def csv_guard(c: Column) -> Column:
    """A quote before values that a spreadsheet would take for formulas."""
    x = text_or_empty(c)
    return F.when(F.rlike(x, F.lit(r"^[=+\-@]")), F.concat(F.lit("'"), x)).otherwise(x)


def scoring_form(c: Column) -> Column:
    """Quotes, dashes and spaces of one kind, for comparing a recognised text with its reference."""
    return compact(F.translate(text_or_empty(c), "«»“”„‐‑‒–—− ", "\"\"\"\"\"------ "))
