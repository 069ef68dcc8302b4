"""Analyzers: from text to arrays of terms, the same for index and query.

Word breaks are runs of letters, digits and underscores, a simplification of
UAX #29 (which keeps 3.14 and don't whole).  Two analyzers read texts: exact
terms, and lemmas: terms without stop words, through the published Snowball
stemmer for Russian and then Porter's for English.  A removed stop word leaves a
gap in the positions.  Stemmers see each distinct term of a batch once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .repair import DASHES
from .text import text_or_empty


def fold(c: Column) -> Column:
    """yo as ye; the number sign, no-break spaces and dashes as plain characters."""
    return F.translate(text_or_empty(c), "ёЁ№ " + DASHES, "еЕ# " + "-" * len(DASHES))


def exact_terms(c: Column) -> Column:
    """Of what `fold` does only yo as ye tells in terms: the other characters stand between them before and after."""
    return F.regexp_extract_all(F.replace(F.lower(text_or_empty(c)), F.lit("ё"), F.lit("е")), F.lit(r"[\p{L}\p{N}_]+"), 0)


def number_terms(c: Column) -> Column:
    """512-р as 512, р and 512р: parts at marks and between letters and digits, and all parts together."""
    words = F.filter(F.split(F.lower(fold(c)), r"\s+"), lambda x: x != "")
    parts = lambda w: F.regexp_extract_all(w, F.lit(r"\p{N}+|\p{L}+"), 0)
    each = F.transform(words, lambda w: F.when(F.size(parts(w)) > 1, F.concat(parts(w), F.array(F.array_join(parts(w), "")))).otherwise(parts(w)))
    return F.filter(F.flatten(each), lambda x: x != "")


def without(terms: Column, stop_words: tuple[str, ...]) -> Column:
    return F.filter(terms, lambda t: ~t.isin(*stop_words)) if stop_words else terms


# The endings of the Snowball stemmer for Russian, longest first within a class.
_PERFECTIVE = r"(?:(?<=[ая])(?:вшись|вши|в)|ывшись|ившись|ывши|ивши|ыв|ив)$"
_REFLEXIVE = r"(?:ся|сь)$"
_ADJECTIVE = r"(?:ими|ыми|его|ого|ему|ому|ее|ие|ые|ое|ей|ий|ый|ой|ем|им|ым|ом|их|ых|ую|юю|ая|яя|ою|ею)$"
_PARTICIPLE = r"(?:(?<=[ая])(?:ем|нн|вш|ющ|щ)|ивш|ывш|ующ)$"
_VERB = r"(?:(?<=[ая])(?:ешь|йте|ете|нно|ем|ла|ли|ло|на|но|ны|ть|ет|ют|й|л|н)|уйте|ейте|ила|ыла|ена|ите|или|ыли|ило|ыло|ено|ены|ует|уют|ить|ыть|ишь|ей|уй|ил|ыл|им|ым|ен|ят|ит|ыт|ую|ю)$"
_NOUN = r"(?:иями|ями|ами|ией|иям|иях|ием|ев|ов|ие|ье|еи|ии|ей|ой|ий|ям|ем|ам|ом|ах|ях|ию|ью|ия|ья|а|е|и|й|о|у|ы|ь|ю|я)$"
_DERIVED = r"(?:ость|ост)$"
_SUPERLATIVE = r"(?:ейше|ейш)$"


def russian_stem(word: str) -> str:
    first = re.search("[аеиоуыэюя]", word)
    if not first:
        return word
    rv = first.end()
    head, tail = word[:rv], word[rv:]
    region = re.search("[аеиоуыэюя][^аеиоуыэюя].*?[аеиоуыэюя][^аеиоуыэюя]", word)
    r2 = region.end() if region else len(word)

    def cut(pattern: str, text: str) -> str | None:
        m = re.search(pattern, text)
        return text[: m.start()] if m else None

    new = cut(_PERFECTIVE, tail)
    if new is None:
        tail = (lambda x: tail if x is None else x)(cut(_REFLEXIVE, tail))
        new = cut(_ADJECTIVE, tail)
        if new is not None:
            new = (lambda x: new if x is None else x)(cut(_PARTICIPLE, new))
        else:
            new = next((x for x in (cut(_VERB, tail), cut(_NOUN, tail)) if x is not None), tail)
    tail = new
    tail = tail[:-1] if tail.endswith("и") else tail
    whole = head + tail
    m = re.search(_DERIVED, whole)
    if m and m.start() >= r2:
        whole = whole[: m.start()]
    tail = whole[rv:]
    if tail.endswith("нн"):
        tail = tail[:-1]
    elif re.search(_SUPERLATIVE, tail):
        tail = re.sub(_SUPERLATIVE, "", tail)
        tail = tail[:-1] if tail.endswith("нн") else tail
    elif tail.endswith("ь"):
        tail = tail[:-1]
    return whole[:rv] + tail


# The Russian stop words of the search engine's list.
RUSSIAN_STOP = frozenset(
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между".split()
)
# The suffixes of Porter's steps 2, 3 and 4, and what stands for them.
PORTER_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
PORTER_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
PORTER_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

# A y after a vowel or in front is a consonant, written Y meanwhile.
_M0, _M1, _MORE = (re.compile(p).match for p in ("[^aeiouy]*[aeiouy]+[^aeiouy]", "[^aeiouy]*[aeiouy]+[^aeiouy]+$", "[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]"))
_CVC, _VOWEL, _TWICE = re.compile(r"[^aeiouy][aeiouy][^aeiouywxY]$").search, re.compile("[aeiouy]").search, re.compile(r"([^aeiouylsz])\1$").search


def _ending(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def english_stem(word: str) -> str:
    """Porter's algorithm; words of one or two letters stay."""
    if len(word) < 3:
        return word
    w = re.sub("^y|(?<=[aeiou])y", "Y", word)
    w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1] if w.endswith("s") and not w.endswith("ss") else w
    if w.endswith("eed"):
        w = w[:-1] if _M0(w[:-3]) else w
    elif (cut := _ending(w, ("ed", "ing"))) and _VOWEL(w[: -len(cut)]):
        w = w[: -len(cut)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _TWICE(w):
            w = w[:-1]
        elif _M1(w) and _CVC(w):
            w += "e"
    if w[-1:] in ("y", "Y") and _VOWEL(w[:-1]):
        w = w[:-1] + "i"
    for table in (PORTER_2, PORTER_3):
        if (cut := _ending(w, table)) and _M0(w[: -len(cut)]):
            w = w[: -len(cut)] + table[cut]
    if (cut := _ending(w, PORTER_4)) and _MORE(w[: -len(cut)]) and (cut != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(cut)]
    if w.endswith("e") and (_MORE(w[:-1]) or _M1(w[:-1]) and not _CVC(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _MORE(w[:-1]):
        w = w[:-1]
    return w.lower()


_CYRILLIC = re.compile("[а-я]").search


@lru_cache(200_000)
def lemma(term: str) -> str | None:
    """What the lemma analyzer makes of an exact term: None for a stop word."""
    if term in RUSSIAN_STOP:
        return None
    return russian_stem(term) if _CYRILLIC(term) else english_stem(term)


@F.pandas_udf(T.ArrayType(T.StringType()))
def lemma_terms(terms: pd.Series) -> pd.Series:
    """Exact terms to lemmas; null where a stop word was."""
    return terms.map(lambda ts: [lemma(t) for t in ts] if ts is not None else None)


@F.pandas_udf(T.StringType())
def stem(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: lemma(t) if isinstance(t, str) else None)
