"""Repair of recognised text, and the one canonical form of act numbers.

Words that mix Latin and Cyrillic look-alikes are rewritten to the script of
their majority, if all letters of the other one have a look-alike.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import mapped
from .text import text_or_empty

# Look-alike letters, dashes, spaces, and the look-alikes of act numbers.
LATIN, CYRILLIC = "ABCEHKMOPTXYaceopxy", "АВСЕНКМОРТХУасеорху"
DASHES = "‐‑‒–—―−"
SPACES = "    ﻿"
NUMBER_LATIN, NUMBER_CYRILLIC = "pPcCaAoOeExXyYkKmMtThHbB", "ррссааооееххууккммттннвв"
HYPHEN_BREAK = r"([А-Яа-яЁёA-Za-z]{2,})[-­‐‑‒–—][ \t]*\r?\n[ \t]*(?=[а-яёa-z]{2,})"
NUMBER_SIGN = r"(?iu)^\s*(?:№|N[оo]?\.?)\s*"
NUMBER_SHAPE = r"(?iu)(?:№|N[оo]?\.?)\s*\d{1,7}(?:\s*[-/]\s*[A-Za-zА-Яа-яЁё0-9]+)?|(?<![\p{L}\p{N}_])\d{1,7}\s*-\s*[а-яё]{1,4}(?![\p{L}\p{N}_])"
NUMBER_SUFFIX = r"(\d{1,7})\s*[-‐‑‒–—−]\s*([A-Za-zА-Яа-яЁё]{1,3})\b"
WORD = r"[^\W\d_]+"

_TO_CYRILLIC, _TO_LATIN = str.maketrans(LATIN, CYRILLIC), str.maketrans(CYRILLIC, LATIN)
_HAS_LATIN, _HAS_CYRILLIC = re.compile("[A-Za-z]"), re.compile("[А-Яа-яЁё]")


def document_number(c: Column) -> Column:
    """The canonical form for index and query: number sign, dashes, look-alikes, blanks and case folded."""
    x = F.trim(F.replace(F.trim(text_or_empty(c)), F.lit(" "), F.lit(" ")))
    x = F.translate(x, DASHES, "-" * len(DASHES))
    x = F.regexp_replace(x, NUMBER_SIGN, "")
    x = F.translate(x, NUMBER_LATIN, NUMBER_CYRILLIC)
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, r"\s*-\s*", "-"), r"(?U)\s+", " ")))


def looks_like_number(c: Column) -> Column:
    """Does a query hold something like an act number?"""
    return F.rlike(text_or_empty(c), F.lit(NUMBER_SHAPE))


def join_hyphens(c: Column) -> Column:
    """Words broken at line ends, over however many lines: what follows a break is only looked at, so the next break joins on."""
    return F.regexp_replace(text_or_empty(c), HYPHEN_BREAK, "$1")


def _convert(word: str, has: re.Pattern, table: dict[int, int]) -> str | None:
    new = word.translate(table)
    return None if has.search(new) else new


def mixed_word(word: str) -> str:
    latin, cyrillic = len(_HAS_LATIN.findall(word)), len(_HAS_CYRILLIC.findall(word))
    if not latin or not cyrillic:
        return word
    ways = [_convert(word, _HAS_LATIN, _TO_CYRILLIC), _convert(word, _HAS_CYRILLIC, _TO_LATIN)]
    return next((w for w in (ways if cyrillic >= latin else ways[::-1]) if w), word)


def _suffix(m: re.Match) -> str:
    new = _convert(m[2], _HAS_LATIN, _TO_CYRILLIC) if _HAS_LATIN.search(m[2]) else None
    return m[0] if new is None else f"{m[1]}-{new}"


def repaired(text: str) -> str:
    """Scripts, number suffixes, spaces and composed letters of one text, in this order."""
    text = re.sub(NUMBER_SUFFIX, _suffix, re.sub(WORD, lambda m: mixed_word(m[0]), text))
    return unicodedata.normalize("NFC", text.translate(_BLANKS))


_BLANKS = str.maketrans(SPACES, " " * len(SPACES))


@F.arrow_udf(T.StringType())
def _repaired(values: pa.Array) -> pa.Array:
    return mapped(values, lambda v: "" if v is None else repaired(v))


def repair(c: Column) -> Column:
    """Hyphens and soft hyphens as expressions, the rest in one Arrow pass."""
    return _repaired(F.replace(join_hyphens(c), F.lit("­"), F.lit("")))


def mixed_count(c: Column) -> Column:
    """Words that hold letters of both scripts."""
    return F.size(F.filter(F.regexp_extract_all(text_or_empty(c), F.lit(r"\p{L}+"), 0), lambda w: F.rlike(w, F.lit("[A-Za-z]")) & F.rlike(w, F.lit("[А-Яа-яЁё]"))))
