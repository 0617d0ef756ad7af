"""Edit distances. Plain Levenshtein is built into Spark; the variant with swaps runs over Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of so many bytes or more are never compared; they count as far apart.
TOO_LONG = 255


def swap_distance(a: str, b: str, swaps: bool = True) -> int:
    """Optimal string alignment: insertions, deletions, replacements and, if wanted, swaps of neighbours cost 1."""
    older: list[int] = []
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(now[-1] + 1, old[j] + 1, old[j - 1] + (x != y))
            if swaps and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            now.append(best)
        older, old = old, now
    return old[-1]


def with_swaps(column: Column, term: str) -> Column:
    """Distance to ``term`` with swaps. Meant for candidates that built-in Levenshtein has already narrowed."""

    @F.pandas_udf("int")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else swap_distance(v, term))

    return run(column)


def distance_to(column: Column, term: str) -> Column:
    far = F.octet_length(column) >= TOO_LONG
    if len(term.encode()) >= TOO_LONG:
        return F.lit(TOO_LONG)
    return F.when(far, F.lit(TOO_LONG)).otherwise(F.levenshtein(column, F.lit(term)))
