"""Error rates of recognised text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import scoring_form


def edit_distance(a: list | str, b: list | str) -> int:
    """Insertions, deletions and replacements between any two sequences."""
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def character_error_rate(reference: Column, found: Column) -> Column:
    a, b = scoring_form(reference), scoring_form(found)
    return F.when(a == "", F.when(b == "", 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), F.levenshtein(a, b) / F.length(a)))


@F.pandas_udf(T.DoubleType())
def _words(reference: pd.Series, found: pd.Series) -> pd.Series:
    def rate(a: str, b: str) -> float:
        x, y = a.split(), b.split()
        return min(1.0, edit_distance(x, y) / len(x)) if x else float(bool(y))

    return pd.Series([rate(a, b) for a, b in zip(reference, found)])


def word_error_rate(reference: Column, found: Column) -> Column:
    return _words(scoring_form(reference), scoring_form(found))
