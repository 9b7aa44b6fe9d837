"""Cuts of a table in key order, found without sorting or gathering its rows.

The key at a given rank is searched for: a bounded sample of keys splits the
table into intervals, whose exact counts tell which one holds the rank; that one
is split again, until so few keys are left that they can be looked at. Only the
key column is read, and a cut is then a filter by key range, which file scans
can use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of a sample, and keys that are looked at.
SAMPLE, HELD = 256, 10_000


def key_range(df: DataFrame, key: str, low=None, high=None) -> DataFrame:
    """Rows with low <= key < high; None leaves a side open."""
    if low is not None:
        df = df.filter(F.col(key) >= F.lit(low))
    return df if high is None else df.filter(F.col(key) < F.lit(high))


def _key_at(keys: DataFrame, rank: int, total: int):
    low = high = None
    below, left = 0, total
    while left > HELD:
        part = key_range(keys, "k", low, high)
        # the keys of least hash are a sample; each task sends at most so many
        sample = sorted({r.k for r in part.orderBy(F.xxhash64("k"), "k").limit(SAMPLE).collect()})
        if len(sample) == 1:
            least, most = part.agg(F.min("k"), F.max("k")).first()
            if least == most:
                return least
            sample = [most]
        place = F.size(F.filter(F.array(*map(F.lit, sample)), lambda s: s <= F.col("k"))).alias("place")
        counts = dict(part.groupBy(place).count().collect())  # one row per interval
        for at in range(len(sample) + 1):
            left = counts.get(at, 0)
            if rank < below + left:
                low, high = (sample[at - 1] if at else low), (sample[at] if at < len(sample) else high)
                break
            below += left
    return sorted(r.k for r in key_range(keys, "k", low, high).collect())[rank - below]


def key_bounds(df: DataFrame, key: str, ranks: Sequence[int]) -> list:
    """The keys at 0-based ranks of the key order, None past its end; a negative rank counts from the end.

    Keys are unique; rows without one are not counted.
    """
    keys = df.select(F.col(key).alias("k")).where(F.col("k").isNotNull())
    total = keys.count()
    ranks = [max(0, total + r) if r < 0 else r for r in ranks]
    return [_key_at(keys, r, total) if r < total else None for r in ranks]
