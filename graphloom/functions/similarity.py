"""String and vector similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, on bits."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def sorted_tokens(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_score(a: str | None, b: str | None) -> float | None:
    """100 for equal words in any order; case counts."""
    if a is None or b is None:
        return None
    a, b = sorted_tokens(a), sorted_tokens(b)
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def _scores(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_sort_score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def token_sort_ratio(a: Column | str, b: Column | str) -> Column:
    """token_sort_score of two columns, in Arrow batches."""
    return F.pandas_udf(_scores, T.DoubleType())(a, b)


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
