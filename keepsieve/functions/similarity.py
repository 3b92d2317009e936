"""Similarity of short names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    m = len(left)
    if m == 0:
        return 0.0
    swaps = sum(x != y for x, y in zip(left, (b[j] for j in range(len(b)) if taken[j]), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity raised by a common prefix of up to four characters, from 0.7 on."""
    j = jaro(a, b)
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return j + 0.1 * prefix * (1 - j) if j > 0.7 else j


def jaro_winkler(text: Column, name: str) -> Column:
    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else jaro_winkler_of(t, name) for t in texts], dtype="float64")

    return of(text)
