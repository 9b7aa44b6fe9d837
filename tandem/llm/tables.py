"""Joins with a side whose size is counted before it may be sent to every worker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a few numbers that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def bounded_join(
    left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str, most: int = BROADCAST_ROWS
) -> DataFrame:
    """Join a staged, slim ``right`` side: broadcast if it has at most ``most`` rows, else shuffled."""
    few = right.limit(most + 1).count() <= most
    return left.join(F.broadcast(right) if few else right.hint("merge"), on, how)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
