"""Toxicity by a character n-gram classifier on naive Bayes log-count ratios.

A text's features are its distinct hashed character n-grams. Over every labelled
training row, the share of toxic and of clean texts holding a feature gives its
log-count ratio. The features whose ratio is further from chance than LEAST_Z
standard errors are kept, all of them, and a
logistic regression is fitted to them, scaled by their ratios, on a bounded
sample of the labelled rows. Ratio times coefficient is one weight per feature,
and scoring is a sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.tables import bounded_join
from tandem.llm.words import slices
from tandem.session import stage

BITS = 22
GRAMS = (3, 4, 5)
SMOOTH = 1.0
#: The least standard errors between the ratio of a feature of the model and 0.
LEAST_Z = 3.0
#: Labelled rows, at most about so many, on which the regression is fitted.
FIT_ROWS = 20_000
PENALTY, ROUNDS = 0.001, 60
FOLDS = 5

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is a multiple of FOLDS."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def codes(text: str) -> np.ndarray:
    """The hashed n-grams of a text, lower-cased, its white space as single spaces; with repeats."""
    signs = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "replace"), np.uint32)
    parts = [np.empty(0, np.uint32)]
    for n in GRAMS:
        if len(signs) >= n:
            code = np.full(len(signs) - n + 1, np.uint32(n))
            for k in range(n):
                code = (code ^ signs[k : len(signs) - n + 1 + k]) * _FACTORS[k]
                code ^= code >> np.uint32(15)
            parts.append(code * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS))
    return np.concatenate(parts)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int32)
    totals, seen = [0, 0], np.empty(1 << BITS, np.int32)
    for batch in slices(batches):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = codes(text or "")
            order = np.arange(len(found), dtype=np.int32)
            seen[found] = order  # of equal features the last one stays
            counts[toxic][found[seen[found] == order]] += 1
            totals[toxic] += 1
    found = np.flatnonzero(counts.sum(0))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.append(found, -1), pa.int32()),
            pa.array(np.append(counts[0][found], totals[0]), pa.int64()),
            pa.array(np.append(counts[1][found], totals[1]), pa.int64()),
        ],
        ["feature", "clean", "toxic"],
    )


def log_count_ratios(labelled: DataFrame) -> tuple[pd.DataFrame, int, int]:
    """((feature, ratio) of the kept features, clean rows, toxic rows) over all of ``labelled`` (text, toxic).

    A worker sends one row per feature it met; the kept features come to the
    driver, at most one per hash (2^BITS), whatever the number of rows.
    """
    sums = stage(
        labelled.select("text", "toxic")
        .mapInArrow(_counted, "feature int, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")),
        "toxic-counts",
    )
    rows = sums.where("feature = -1").first()
    n_clean, n_toxic = (rows["clean"], rows["toxic"]) if rows else (0, 0)
    clean, toxic = F.col("clean") + SMOOTH, F.col("toxic") + SMOOTH
    ratio = F.log(toxic / (n_toxic + 2 * SMOOTH)) - F.log(clean / (n_clean + 2 * SMOOTH))
    error = F.sqrt(1 / toxic + 1 / clean)
    kept = (
        sums.where("feature >= 0")
        .select("feature", ratio.alias("ratio"), F.abs(ratio / error).alias("z"))
        .where(F.col("z") >= LEAST_Z)
        .toPandas()
    )
    return kept.sort_values("feature")[["feature", "ratio"]].reset_index(drop=True), n_clean, n_toxic


@dataclass
class Model:
    """The weights of a few hashed features, and a constant."""

    features: np.ndarray
    weights: np.ndarray
    constant: float


def _places(features: np.ndarray) -> np.ndarray:
    """For each hash the place of its feature, counted from 1, or 0."""
    out = np.zeros(1 << BITS, np.uint32)
    out[features] = np.arange(1, len(features) + 1)
    return out


def _present(text: str, places: np.ndarray) -> np.ndarray:
    """The places, counted from 0, of the kept features a text holds."""
    found = places[codes(text)]
    return np.unique(found[found > 0]).astype(np.int32) - 1


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from the labelled rows of ``docs`` that are not held out.

    ``labels`` has doc_id and toxic (0 or 1; other rows are passed over, and a
    document with labels of both kinds counts as toxic). Without a row of either kind
    the score is the share of toxic rows, or 0.1 if there is no row at all.
    """
    marks = stage(
        labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic")),
        "toxic-labels",
    )
    labelled = bounded_join(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), marks, "doc_id", "inner"
    )
    kept, n_clean, n_toxic = log_count_ratios(labelled)
    n = n_clean + n_toxic
    if not n_clean or not n_toxic or not len(kept):
        share = (n_toxic + 0.1) / (n + 1)
        return Model(np.empty(0, np.int32), np.empty(0), float(np.log(share / (1 - share))))
    spark = docs.sparkSession
    lot = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(min(1.0, fit_rows / n) * (1 << 20)) + 1
    shared = spark.sparkContext.broadcast((kept.feature.to_numpy(), kept.ratio.to_numpy()))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _places(shared.value[0])
        for batch in slices(batches):
            own = [_present(t or "", places) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.list_(pa.int32()))], ["toxic", "found"])

    rows = stage(
        labelled.where(lot).select("text", "toxic").mapInArrow(featured, "toxic int, found array<int>"), "toxic-rows"
    )

    @F.udf(VectorUDT())
    def scaled(found):
        ratios = shared.value[1]
        return Vectors.sparse(len(ratios), found, ratios[found])

    # a bounded sample in four partitions: each sends a whole gradient a round
    sample = rows.repartition(4).select(scaled("found").alias("features"), F.col("toxic").cast("double").alias("label"))
    fitted = LogisticRegression(maxIter=ROUNDS, regParam=PENALTY, standardization=False).fit(sample)
    return Model(shared.value[0], fitted.coefficients.toArray() * shared.value[1], float(fitted.intercept))


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A column function: the score, 0 to 1, of a whole text; null counts as empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        places = _places(model.features)
        for texts in parts:
            sums = [
                model.constant + float(model.weights[_present(t or "", places)].sum()) for t in texts
            ]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(sums, float), -30, 30))))

    return lambda text: scores(text.cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Score every whole text of ``docs``, learning from the labels that are not held out.

    Reads ``doc_id`` and ``text``, ignores other columns; only the text enters a
    score. Returns per row doc_id, held_out, score and predicted. Null and empty texts
    are scored as texts without n-grams of their own; repeated rows are scored each;
    a null id is held out. An empty table gives an empty result.
    """
    score = scorer(docs.sparkSession, fit(docs, labels, fit_rows))
    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), score(F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
