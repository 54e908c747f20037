"""Text similarity that Spark has no built-in for, a batch at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from samewise.functions.text import blank_to_null, trim


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, mine = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    theirs = [y for y, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro with a bonus for up to four equal first letters, where Jaro is over 0.7."""
    s = jaro(a, b)
    if s <= 0.7:
        return s
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return s + same * weight * (1 - s)


@pandas_udf(T.DoubleType())
def jaro_winkler_col(left: pd.Series, right: pd.Series) -> pd.Series:
    memo: dict[tuple[str, str], float] = {}

    def one(a, b):
        if a is None or b is None:
            return None
        if (a, b) not in memo:
            memo[a, b] = jaro_winkler(a, b)
        return memo[a, b]

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def similarity_lt(left: Column, right: Column, limit: float) -> Column:
    """Both there and less alike than the limit, trimmed and without case."""
    a, b = (F.upper(blank_to_null(trim(c.cast("string")))) for c in (left, right))
    return F.coalesce(jaro_winkler_col(a, b) < limit, F.lit(False))


def damerau_levenshtein(a: str, b: str) -> int:
    """Edits and swaps of neighbours (the unrestricted distance), with the last row of each letter kept."""
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    last: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        row, seen = [far, i], 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), seen
            if x == y:
                cost, seen = 0, j
            else:
                cost = 1
            row.append(min(rows[i][j] + cost, row[j] + 1, rows[i][j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        rows.append(row)
        last[x] = i
    return rows[-1][-1]


@pandas_udf(T.IntegerType())
def damerau_col(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else damerau_levenshtein(a, b) for a, b in zip(left, right, strict=True)], dtype="Int32")


@pandas_udf(T.DoubleType())
def jaro_col(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else jaro(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")
