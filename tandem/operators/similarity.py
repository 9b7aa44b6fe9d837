"""Embedding comparisons: cosine of paired vectors and greedy token matching."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tandem.functions.arrays import cosine

BLOCK = 1024


def similarity_by_sample(
    vectors: DataFrame, key: str = "sample_id", a: str = "predicted_vec", b: str = "neutral_vec"
) -> DataFrame:
    """Cosine of each sample's two vectors. Only the pairs are computed."""
    return vectors.select(key, cosine(F.col(a), F.col(b)).alias("similarity"))


def _unit_rows(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype="float64") for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _greedy_f1(a, b) -> float:
    """F1 of mean best cosines, one block of the table in memory at a time."""
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0.0
    left, right = _unit_rows(a), _unit_rows(b)
    best_left = np.full(len(left), -np.inf)
    best_right = np.full(len(right), -np.inf)
    for i in range(0, len(left), BLOCK):
        for j in range(0, len(right), BLOCK):
            table = left[i : i + BLOCK] @ right[j : j + BLOCK].T
            best_left[i : i + BLOCK] = np.maximum(best_left[i : i + BLOCK], table.max(axis=1))
            best_right[j : j + BLOCK] = np.maximum(best_right[j : j + BLOCK], table.max(axis=0))
    precision, recall = best_left.mean(), best_right.mean()
    total = precision + recall
    return float(2 * precision * recall / total) if total else 0.0


def _vectors(listed: pa.Scalar) -> list[np.ndarray] | None:
    return [v.values.to_numpy(zero_copy_only=False) for v in listed.values] if listed.is_valid else None


@F.arrow_udf(DoubleType())
def greedy_f1(a: pa.Array, b: pa.Array) -> pa.Array:
    """Greedy-matching F1 of two arrays of token vectors; the vectors of one row are apart from the batch at a time."""
    return pa.array([_greedy_f1(_vectors(x), _vectors(y)) for x, y in zip(a, b)], pa.float64())


def greedy_match_by_sample(
    vectors: DataFrame,
    key: str = "sample_id",
    a: str = "predicted_vecs",
    b: str = "neutral_vecs",
) -> DataFrame:
    """Token-matching F1 per sample; a sample's vectors are arrays in its row."""
    return vectors.select(key, greedy_f1(a, b).alias("bertscore_f1"))


def vector_scores(vectors: DataFrame, key: str = "sample_id") -> DataFrame:
    """Both comparisons of each sample, from one reading of its vectors."""
    return vectors.select(
        key,
        cosine(F.col("predicted_vec"), F.col("neutral_vec")).alias("similarity"),
        greedy_f1("predicted_vecs", "neutral_vecs").alias("bertscore_f1"),
    )
