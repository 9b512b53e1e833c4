"""Edit distance that counts a swap of neighbours as one edit, over Arrow batches of candidate pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def osa(a: str, b: str) -> int:
    """Optimal string alignment distance."""
    if a == b:
        return 0
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        row = [i]
        for j, cb in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and cb == a[i - 2]:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def _batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="Int32")


def with_edits(pairs: DataFrame, a: str, b: str, most: int, name: str = "edits") -> DataFrame:
    """The ``pairs`` within ``most`` edits, with their distance.

    Plain edit distance decides all but those a swap could bring nearer: only
    pairs of two plain edits or more go to Python.
    """
    plain = pairs.withColumn(name, F.levenshtein(a, b, 2 * most)).where(F.col(name) >= 0)
    near = plain.where(F.col(name) <= 1)
    rest = plain.where(F.col(name) > 1).withColumn(name, F.pandas_udf(_batch, "int")(a, b))
    return near.unionByName(rest).where(F.col(name) <= most)
