"""The first k rows of an order, k being a share of the table: by finding the k-th row, not by sorting towards one task.

A sample gives two rows that lie around the k-th with high probability; one pass counts what comes before, between and
after them, and the search goes on in the part that has the k-th, until that is small. Three or four passes over a few
columns do for any size, nothing is shuffled, and the answer is exact whatever the sample.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Rows among which the k-th is looked up by sorting, and rows of a sample.
SMALL, SAMPLE = 1 << 16, 1 << 12

#: Column names, with whether they are descending. Nulls come first, in descending columns last; NaN is the greatest number.
Order = Sequence[tuple[str, bool]]


def sort_columns(order: Order) -> list[Column]:
    return [F.desc(c) if down else F.asc(c) for c, down in order]


def ahead(order: Order, row: Row | Sequence, or_equal: bool = False) -> Column:
    """Whether a row comes before the given values in the order."""
    out = F.lit(or_equal)
    for (name, down), v in reversed(list(zip(order, row))):
        c = F.col(name)
        if v is None:
            before = c.isNotNull() if down else F.lit(False)
        else:
            before = c > F.lit(v) if down else c.isNull() | (c < F.lit(v))
        out = F.coalesce(before, F.lit(False)) | (c.eqNullSafe(F.lit(v)) & out)
    return out


def kth(df: DataFrame, k: int, order: Order, seed: int = 1) -> Row | None:
    """The values that the k-th row (from 1) of df has in the order's columns; None beyond the last row.

    df is read several times: pass a written table, or one that is cheap to compute.
    """
    rows, size = df.select(*[c for c, _ in order]), df.count()
    if not 0 < k <= size:
        return None
    inside, above, below = rows, F.lit(True), F.lit(True)
    while size > SMALL:
        seed += 1
        sample = inside.sample(min(1.0, SAMPLE / size), seed).orderBy(*sort_columns(order)).collect()
        if not sample:
            continue
        at, spread = k / size * len(sample), 3 * math.sqrt(len(sample))
        low, high = sample[max(0, int(at - spread))], sample[min(len(sample) - 1, int(at + spread))]
        counts = [ahead(order, low), ahead(order, low, True), ahead(order, high), ahead(order, high, True)]
        a, b, c, d = inside.agg(*[F.count_if(x) for x in counts]).head()
        # what is equal to low or high is settled here, so many equal rows don't keep a part large
        if a < k <= b:
            return low
        if c < k <= d:
            return high
        if k <= a:
            below, size = ahead(order, low), a
        elif k <= c:
            above, below, size, k = ~ahead(order, low, True), ahead(order, high), c - b, k - b
        else:
            above, size, k = ~ahead(order, high, True), size - d, k - d
        inside = rows.where(above & below)
    return inside.orderBy(*sort_columns(order)).offset(k - 1).limit(1).head()


def within(df: DataFrame, k: int, order: Order) -> Column:
    """Whether a row of df is among the first k in the order. Rows that are equal in all its columns are so together."""
    if k <= 0:
        return F.lit(False)
    last = kth(df, k, order)
    return F.lit(True) if last is None else ahead(order, last, True)


def first_rows(df: DataFrame, k: int, order: Order) -> DataFrame:
    """The rows of df that are among the first k in the order."""
    return df.where(within(df, k, order))
