"""String distances: optimal string alignment and Jaro-Winkler."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["osa", "jaro_winkler", "osa_column", "jaro_winkler_column"]


def osa(a: str, b: str) -> int:
    """Edits and swaps of neighbours, each place edited once."""
    if a == b:
        return 0
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before2, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before2[j - 2] + 1)
    return row[-1]


@functools.lru_cache(1 << 16)
def jaro_winkler(a: str, b: str, p: float = 0.1) -> float:
    """Similarity from 0 to 1; ``p`` weighs a common beginning of up to four letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(len(b)) if taken[j]]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    common = 0
    while common < min(4, len(a), len(b)) and a[common] == b[common]:
        common += 1
    return jaro + common * p * (1 - jaro)


def osa_column(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def udf(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else osa(s, t) for s, t in zip(x, y, strict=True)], dtype="Int32")

    return udf(a, b)


def jaro_winkler_column(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def udf(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else jaro_winkler(s, t) for s, t in zip(x, y, strict=True)], dtype="float64")

    return udf(a, b)
