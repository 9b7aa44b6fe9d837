"""Dense row numbers over whole tables, without one task seeing every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.session import stage

# monotonically_increasing_id() keeps the partition above bit 33, the row below.
_ROW_BITS = 33


def _laid_out(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` range-partitioned and sorted, written once so that the layout is fixed.

    ``_part`` is a row's partition and ``_place`` its place there, from 0.
    """
    placed = stage(
        df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordinals"
    )
    return placed.withColumns(
        {
            "_part": F.shiftright("_at", _ROW_BITS),
            "_place": F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        }
    ).drop("_at")


def _sums_before(laid_out: DataFrame, value: Column) -> DataFrame:
    """(_part, _offset): the total of ``value`` over all earlier partitions.

    One row per shuffle partition, so bounded by configuration, not by the data;
    only these are summed in one task, and they may be broadcast.
    """
    sums = laid_out.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))


def with_ordinals(
    df: DataFrame, order: Sequence[Column | str], name: str = "row_idx"
) -> DataFrame:
    """Number rows 0, 1, 2, ... in a total ``order`` (ties are not allowed)."""
    laid_out = _laid_out(df, order)
    offsets = _sums_before(laid_out, F.lit(1))
    return (
        laid_out.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_place"))
        .drop("_part", "_place", "_offset")
    )


def with_running_total(
    df: DataFrame, order: Sequence[Column | str], value: str, name: str
) -> DataFrame:
    """Add the total of ``value`` over all rows before each one in a total ``order``."""
    laid_out = _laid_out(df, order)
    offsets = _sums_before(laid_out, F.col(value))
    inside = (
        Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        laid_out.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col(name) + F.col("_offset"))
        .drop("_part", "_place", "_offset")
    )


def with_file_ordinals(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Number rows of a file scan in file order, without sorting the rows.

    ``df`` must be a bare file scan. Rows of one block keep their order within a
    task, so a row's number is its distance from the block's first row plus the
    rows of all earlier blocks. Only the summary, one row per block, is sorted; where it is
    too large to broadcast, the join moves the rows once.
    """
    block = ["_path", "_start"]
    numbered = df.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    blocks = numbered.groupBy(*block).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first")
    )
    offsets = with_running_total(blocks, block, "_rows", "_before").select(
        *block, (F.col("_before") - F.col("_first")).alias("_shift")
    )
    return (
        numbered.join(offsets, block)
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .drop(*block, "_at", "_shift")
    )
