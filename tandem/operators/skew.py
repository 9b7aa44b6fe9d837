"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_KEYS = 1000
SPREAD = 32
HOT_ROWS = 100_000
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def placed_by(df: DataFrame, key: str) -> DataFrame:
    """Rows hashed by ``key`` over the configured number of shuffle partitions.

    For narrow rows that are about to be unfolded many times over: the count is
    fixed so that adaptive execution does not merge them by their size now.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key)


def hot_hashes(df: DataFrame, keys: Sequence[str], min_rows: int) -> list[int]:
    """Hashes of the most frequent keys: at most ``HOT_KEYS`` numbers.

    Every key holding over 1/HOT_KEYS of the rows is among them. The count
    combines on the map side, and only the key columns are read.
    """
    hottest = (
        df.groupBy(F.xxhash64(*keys).alias("hash"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") >= min_rows)
        .orderBy(F.desc("rows"), "hash")
        .limit(HOT_KEYS)
    )
    return [row.hash for row in hottest.collect()]


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    min_rows: int = HOT_ROWS,
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Equi-join in which frequent left keys are split over ``SPREAD`` tasks.

    ``right`` must hold few rows per key (it is repeated ``SPREAD`` times for
    the frequent keys only). ``spread_by`` names left columns that tell rows of
    one key apart; the salt is a hash of them, so a retried task makes the same
    choice. ``how`` is one of inner, left, left_semi, left_anti. Without a key of
    ``min_rows`` rows it is a plain join.
    """
    keys = list(keys)
    hot = hot_hashes(left, keys, min_rows)
    if not hot:
        return left.join(right, keys, how)
    is_hot = F.xxhash64(*keys).isin(hot)
    none, last = F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint")
    salt = F.pmod(F.xxhash64(*(spread_by or left.columns)), F.lit(SPREAD))
    copies = F.when(is_hot, F.sequence(none, last)).otherwise(F.array(none))
    return (
        left.withColumn("_salt", F.when(is_hot, salt).otherwise(none))
        .join(right.withColumn("_salt", F.explode(copies)), [*keys, "_salt"], how)
        .drop("_salt")
    )


def small_enough(table: DataFrame) -> bool:
    """True when a table of plain columns is counted to be fit for broadcasting."""
    plain = (T.StringType, T.BooleanType, T.NumericType, T.DatetimeType)
    if not all(isinstance(field.dataType, plain) for field in table.schema):
        return False
    texts = [f.name for f in table.schema if isinstance(f.dataType, T.StringType)]
    width = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(0))
    counted = table.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(width.cast("bigint")), F.lit(0)).alias("bytes"),
    ).first()
    return counted.rows <= BROADCAST_ROWS and counted.bytes <= BROADCAST_BYTES


def lookup_join(
    left: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Join to a key-unique table: broadcast when counted small, salted otherwise."""
    if small_enough(table):
        return left.join(F.broadcast(table), list(keys), how)
    return salted_join(left, table, keys, how, spread_by=spread_by)
