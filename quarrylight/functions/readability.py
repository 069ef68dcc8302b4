"""Readability of a text layer: a score from 0 to 100 and the reason for the verdict, as one expression tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import compact

# Common words that speak for a real text.
RUSSIAN = "администрация города город сочи постановление распоряжение решение приказ указ муниципального образования краснодарского края внести утверждении настоящее приложение соответствии года".split()
ENGLISH = "a an and administration are as at by city document for from in is of official on or ready resolution the this to with".split()
SUSPICIOUS = r"[{}\[\]\\|^~`_]"
VOWELS = "[аеёиоуыэюяaeiouy]"


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def measures(df: DataFrame, column: str = "text") -> DataFrame:
    """df with a struct `m` of all counts and ratios that the rules use."""
    t = compact(F.col(column))
    words = F.regexp_extract_all(t, F.lit("[A-Za-zА-Яа-яЁё]{2,}"), 0)
    df = df.withColumn("_t", t).withColumn("_w", words)
    t, w = F.col("_t"), F.col("_w")
    lower = F.transform(w, F.lower)
    n = F.size(w)
    size_of = lambda cond: F.size(F.filter(w, cond))
    title = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))
    mixed = lambda x: (F.length(x) >= 4) & (x != F.lower(x)) & (x != F.upper(x)) & (x != title(x))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    chars, letters = F.length(t), _count(t, r"\p{L}")
    digits = _count(t, r"\p{Nd}")
    m = F.struct(
        chars.alias("characters"), letters.alias("letters"), digits.alias("digits"), n.alias("words"),
        ratio(_count(t, "[А-Яа-яЁё]"), letters).alias("cyrillic"), ratio(_count(t, "[A-Za-z]"), letters).alias("latin"),
        ratio(_count(t, SUSPICIOUS), chars).alias("suspicious"),
        F.size(F.filter(lower, lambda x: x.isin(*RUSSIAN) | x.isin(*ENGLISH))).alias("hits"), F.size(F.filter(lower, lambda x: x.isin(*ENGLISH))).alias("english"),
        ratio(size_of(lambda x: F.rlike(F.lower(x), F.lit(VOWELS))), n).alias("vowels"), ratio(size_of(mixed), n).alias("mixed"),
        ratio(F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x)), n).alias("mean"), ratio(size_of(lambda x: F.length(x) <= 2), n).alias("short"),
        ratio(chars - _count(t, r"[\p{C}\p{Zl}\p{Zp}]"), chars).alias("printable"), ratio(letters + digits, chars).alias("alnum"),
    )
    return df.withColumn("m", m).drop("_t", "_w")


def readability(df: DataFrame, column: str = "text", minimum: int = 80) -> DataFrame:
    """df with score, reason, readable and the three rounded ratios."""
    df = measures(df, column)
    m = {k: F.col(f"m.{k}") for k in ("characters", "letters", "digits", "words", "cyrillic", "latin", "suspicious", "hits", "english", "vowels", "mixed", "mean", "short", "printable", "alnum")}
    russian = (m["cyrillic"] >= 0.28) & (m["words"] >= 3) & (m["mean"] >= 3.1)
    english = (m["latin"] >= 0.70) & (m["english"] >= F.greatest(F.lit(2), F.ceil(m["words"] * 0.04)))
    table = (m["digits"] >= 20) & (m["alnum"] >= 0.55) & (m["words"] >= 3)
    unknown = (m["letters"] >= 40) & (m["latin"] >= 0.70) & ~english
    fragments = (m["words"] >= 10) & (m["mean"] < 3.1) & (m["short"] >= 0.45)
    implausible = (m["letters"] >= 40) & m["cyrillic"].between(0.18, 0.75) & (m["latin"] >= 0.20) & (m["hits"] < 2) & (m["short"] >= 0.35)

    def steps(x: Column, *levels: tuple[float, int]) -> Column:
        out = F.when(x >= levels[0][0], levels[0][1])
        for least, points in levels[1:]:
            out = out.when(x >= least, points)
        return out.otherwise(0)

    flag = lambda c, points: F.when(c, points).otherwise(0)
    score = steps(m["characters"], (minimum, 15), (max(20, minimum // 2), 7)) + steps(m["printable"], (0.98, 10), (0.90, 5)) + steps(m["alnum"], (0.55, 10), (0.35, 5)) + steps(m["words"], (8, 10), (3, 5))
    score = score + F.when(russian, 38).when(english, 34).when(table, 20).otherwise(0) + steps(m["vowels"], (0.65, 8), (0.40, 4)) + F.least(F.lit(9), m["hits"] * 3)
    score = score - flag(unknown, 35) - flag(fragments, 30) - flag(implausible, 25) - steps(m["mixed"], (0.25, 22), (0.12, 10)) - steps(m["suspicious"], (0.025, 20), (0.01, 8))
    df = df.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)))
    rules = [(m["characters"] < minimum, "too_short"), ((m["letters"] < 20) & ~table, "too_few_letters"), (unknown, "unknown_latin_glyph_layer"), (fragments, "fragmented_words"), (implausible, "implausible_mixed_script"), (m["mixed"] >= 0.25, "suspicious_mixed_case"), (m["suspicious"] >= 0.025, "suspicious_symbols"), (F.col("score") < 55, "low_quality_score")]
    reason = F.when(*rules[0])
    for rule, name in rules[1:]:
        reason = reason.when(rule, name)
    df = df.withColumn("reason", reason.otherwise("readable")).withColumn("readable", F.col("reason") == "readable")
    return df.withColumns({f"{k}_ratio": F.bround(m[k], 4) for k in ("cyrillic", "latin", "suspicious")})


def garbled(df: DataFrame, column: str = "text", minimum: int = 80) -> DataFrame:
    """df with `garbled`: long enough to judge, and not readable."""
    return readability(df, column, minimum).withColumn("garbled", (F.col("m.characters") >= minimum) & ~F.col("readable"))
