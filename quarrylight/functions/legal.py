"""Numbers, dates and kinds of legal acts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MONTHS_GENITIVE, compact, text_or_empty

# Kinds in their order, labels of a page's table.
KINDS = ("постановление", "распоряжение", "решение", "приказ", "положение", "указ")
RESERVED = ("номер документа", "дата документа", "тип документа", "опубликовано на сайте", "скачать документ", "скачать файл", "формат файла", "размер")
# What a number's mark, a number and the dates of an act look like.
NUMBER_MARK, NUMBER = r"(?:№|N[oо]?\.?)", r"([0-9А-Яа-яЁё\-/–—]+)"
DATE_AFTER = r"от\s+((?:\d{1,2}[.\-/]\d{1,2}[.\-/]\d{4})|(?:\d{1,2}\s+[а-яё]+\s+\d{4}(?:\s+года)?))"
_EDGE, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _label(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(compact(c), ":+$", "")))


def valid_number(c: Column) -> Column:
    """A number with a digit, of 100 characters at most, that isn't a label; else null."""
    x = F.regexp_replace(compact(c), r"^[ .,:;]+|[ .,:;]+$", "")
    return F.when((x != "") & ~_label(x).isin(*RESERVED) & (F.length(x) <= 100) & F.rlike(x, F.lit(r"\d")), x)


def canonical_kind(c: Column) -> Column:
    x = F.lower(compact(c))
    found = F.lit(None).cast("string")
    for kind in KINDS[::-1]:
        found = F.when(F.rlike(x, F.lit(_EDGE + kind + _END)), F.lit(kind.capitalize())).otherwise(found)
    return F.when(~_label(x).isin(*RESERVED), found)


def russian_date(c: Column) -> Column:
    """The first d.m.yyyy, or else d month yyyy, as an ISO date; null if there is no such day."""
    x = F.lower(compact(c))
    numeric = _EDGE + r"(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{4})" + _END
    spoken = _EDGE + r"(\d{1,2})\s+([а-яё]+)\s+(\d{4})" + _END
    at = lambda pattern, k: F.nullif(F.regexp_extract(x, pattern, k), F.lit(""))
    iso = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd").cast("string")
    month = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS_GENITIVE]), at(spoken, 2)), F.lit(0)).cast("string")
    return F.when(at(numeric, 1).isNotNull(), iso(at(numeric, 3), at(numeric, 2), at(numeric, 1))).when(month.isNotNull(), iso(at(spoken, 3), month, at(spoken, 1)))


def title_metadata(c: Column) -> Column:
    """struct<kind, number, date>: a kind in the first 500 characters, number and date in the 320 from there."""
    x = compact(c)
    kind_pattern = "(?iu)" + _EDGE + "(" + "|".join(KINDS) + ")" + _END
    head = F.substring(x, 1, 500)
    kind = F.regexp_extract(head, kind_pattern, 1)
    start = F.regexp_instr(head, F.lit(kind_pattern))
    header = F.substring(x, start, F.lit(320))
    number = F.regexp_extract(header, "(?iu)" + NUMBER_MARK + r"\s*" + NUMBER, 1)
    date = F.regexp_extract(header, "(?iu)" + _EDGE + DATE_AFTER, 1)
    return F.struct(F.when(kind != "", canonical_kind(kind)).alias("kind"), F.when(kind != "", valid_number(number)).alias("number"), F.when(kind != "", russian_date(date)).alias("date"))


def header_reliable(c: Column) -> Column:
    """A kind in the first 1200 characters with a number and a possible date in the 320 from there."""
    x = compact(c)
    kind_pattern = "(?iu)" + _EDGE + "(" + "|".join(KINDS) + ")" + _END
    head = F.substring(x, 1, 1200)
    header = F.substring(x, F.regexp_instr(head, F.lit(kind_pattern)), F.lit(320))
    number = F.rlike(header, F.lit("(?iu)" + NUMBER_MARK + r"\s*\d{1,7}"))
    return F.rlike(head, F.lit(kind_pattern)) & number & russian_date(F.regexp_extract(header, "(?iu)" + _EDGE + r"от\s+(.{8,40})", 1)).isNotNull()


def labelled_value(c: Column, label: str) -> Column:
    """What stands after 'label:' on its line, or on the line after the label; null for another label."""
    lines = F.filter(F.transform(F.split(text_or_empty(c), r"\r\n?|\n"), lambda x: F.trim(x)), lambda x: x != "")
    want = label.strip().rstrip(":").lower()
    inline = lambda x: F.startswith(F.lower(x), F.lit(want + ":")) & (F.trim(F.substring(x, F.lit(len(want) + 2), F.length(x))) != "")
    alone = lambda x: F.lower(F.trim(F.regexp_replace(x, ":+$", ""))) == want
    flags = F.transform(lines, lambda x: alone(x) | inline(x))
    at = F.array_position(flags, F.lit(True)).cast("int")
    line = F.try_element_at(lines, F.nullif(at, F.lit(0)))
    following = compact(F.try_element_at(lines, F.nullif(at, F.lit(0)) + 1))
    return F.when(at == 0, None).when(alone(line), F.when((following != "") & ~_label(following).isin(*RESERVED), following)).otherwise(compact(F.substring(line, F.lit(len(want) + 2), F.length(line))))


def header_needs_ocr(c: Column) -> Column:
    """A kind of act at the top, but no number and possible date beside it."""
    kind_pattern = "(?iu)" + _EDGE + "(" + "|".join(KINDS) + ")" + _END
    return F.rlike(F.substring(compact(c), 1, 1200), F.lit(kind_pattern)) & ~header_reliable(c)


def page_metadata(text: Column, url: Column) -> Column:
    """struct<number, date, kind> of a whole page: its labels first, then what stands at the top of a detail page.

    A page is one of a single act if its URL has an element id or its text has
    one of the labels; only then numbers and kinds in running text count, and a
    number without a kind before it only beside the labels.
    """
    x = text_or_empty(text)
    labels = F.lit(False)
    for label in RESERVED[:3]:
        labels = labels | F.contains(F.lower(x), F.lit(label))
    detail = labels | F.contains(F.lower(text_or_empty(url)), F.lit("element_id="))
    typed = "(?isu)" + _EDGE + "(?:" + "|".join(KINDS) + ")" + _END + r".{0,180}?" + NUMBER_MARK + r"\s*" + NUMBER
    near = F.when(detail, valid_number(F.regexp_extract(F.substring(x, 1, 2500), typed, 1)))
    bare = F.when(labels, valid_number(F.regexp_extract(F.substring(x, 1, 1500), "(?iu)" + NUMBER_MARK + r"\s*" + NUMBER, 1)))
    number = F.coalesce(valid_number(labelled_value(x, "Номер документа")), near, bare)
    kind = F.coalesce(canonical_kind(labelled_value(x, "Тип документа")), F.when(detail, canonical_kind(F.substring(x, 1, 2500))))
    return F.struct(number.alias("number"), russian_date(labelled_value(x, "Дата документа")).alias("date"), kind.alias("kind"))
