"""Positional splits, batch numbers and split audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators.bounds import key_bounds, key_range
from tandem.operators.ordinals import with_ordinals
from tandem.operators.skew import lookup_join
from tandem.sources.corpus import drop_null_pairs

# Rows of the splits, counted before null pairs are dropped.
TRAIN_ROWS, VALIDATION_ROWS, TEST_ROWS = 3000, 300, 300
SPLITS = ("train", "validation", "test", "full")

# Fixed value: source texts per training iteration.
BATCH_ROWS = 25


def take_split(
    df: DataFrame,
    split: str,
    key: str = "sample_id",
    train: int = TRAIN_ROWS,
    validation: int = VALIDATION_ROWS,
    test: int = TEST_ROWS,
) -> DataFrame:
    """The rows of one split of ``df`` in ``key`` order; keys are unique.

    train is the head, validation follows it, test is the tail, full is all.
    Splits may overlap on small tables. A split is a filter by key range.
    """
    if split not in SPLITS:
        raise ValueError(f"no split named {split}")
    if split == "full":
        return df
    df = df.where(F.col(key).isNotNull())
    if split == "test":
        return key_range(df, key, *key_bounds(df, key, [-test])) if test else df.limit(0)
    if split == "train":
        return key_range(df, key, None, *key_bounds(df, key, [train]))
    low, high = key_bounds(df, key, [train, train + validation])
    return df.limit(0) if low is None else key_range(df, key, low, high)


def split_pairs(pairs: DataFrame, split: str, **sizes) -> DataFrame:
    """Cut first, then drop null pairs: a split may hold fewer rows than its cut."""
    return drop_null_pairs(take_split(pairs, split, **sizes))


def assign_batches(df: DataFrame, key: str = "sample_id", size: int = BATCH_ROWS) -> DataFrame:
    """``iteration`` and ``sample_idx`` within it, in ``key`` order; keys are unique.

    Only keys are sorted and numbered; the rows look their numbers up.
    """
    numbered = lookup_join(df, with_ordinals(df.select(key), [key]), [key], "inner")
    return _numbered(numbered, size)


def _numbered(df: DataFrame, size: int) -> DataFrame:
    return df.withColumns(
        {
            "iteration": F.floor(F.col("row_idx") / size).cast("bigint"),
            "sample_idx": F.col("row_idx") % size,
        }
    )


def batch_rows(df: DataFrame, iteration: int, key: str = "sample_id", size: int = BATCH_ROWS) -> DataFrame:
    """The rows of one iteration, numbered as ``assign_batches`` does, read by their key range alone."""
    low, high = key_bounds(df, key, [iteration * size, (iteration + 1) * size])
    if low is None:
        rows = df.limit(0)
    else:
        rows = key_range(df.where(F.col(key).isNotNull()), key, low, high)
    # at most ``size`` rows
    place = F.row_number().over(Window.orderBy(key)) - 1 + F.lit(iteration * size).cast("bigint")
    return _numbered(rows.withColumn("row_idx", place), size)


def split_overlap(df: DataFrame, key: str = "sample_id", text: str = "biased", **sizes) -> DataFrame:
    """For each pair of splits: shared rows, and rows whose text is in the other.

    Rows are counted per text first, so equal texts never pair up row by row.
    """
    names = [name for name in SPLITS if name != "full"]
    tagged = None
    for name in names:
        part = take_split(df, name, key, **sizes).select(key, text, F.lit(name).alias("split"))
        tagged = part if tagged is None else tagged.unionByName(part)

    def members(by: str) -> DataFrame:
        counts = [F.count_if(F.col("split") == name).alias(name) for name in names]
        return tagged.groupBy(by).agg(*counts)

    combos = [(a, b) for at, a in enumerate(names) for b in names[at + 1 :]]

    def shared(counts: DataFrame, label: str) -> DataFrame:
        sums = [
            F.coalesce(F.sum(F.when(F.col(b) > 0, F.col(a))), F.lit(0)).alias(f"{a}|{b}")
            for a, b in combos
        ]
        return counts.agg(*sums).select(
            F.inline(
                F.array(
                    *(
                        F.struct(
                            F.lit(a).alias("split_a"),
                            F.lit(b).alias("split_b"),
                            F.lit(label).alias("shared"),
                            F.col(f"{a}|{b}").alias("rows"),
                        )
                        for a, b in combos
                    )
                )
            )
        )

    return shared(members(key), "row").unionByName(shared(members(text), "text"))
