"""Classes and collections: few by nature, which is checked before they are repeated for every question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes, or collections, that a system may have.
MOST = 1000


def values(df: DataFrame, column: str) -> list:
    """The values of a column, in order; more than ``MOST`` are refused."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST + 1).collect()  # as many as the limit
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} values of {column}")
    return sorted(r[0] for r in rows)


def each(found: list, kind: str) -> Column:
    """A row for each of the values."""
    return F.explode(F.array(*[F.lit(x) for x in found]).cast(f"array<{kind}>"))
