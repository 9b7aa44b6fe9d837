"""Full evaluation of predictions: one row of corpus metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.text import words
from tandem.operators.overlap import bleu_sums, bleu_value, overlap_by_sample, rouge_f1
from tandem.operators.sequences import meteor_by_sample, rouge_l_by_sample
from tandem.operators.similarity import vector_scores
from tandem.session import stage

# Metric names, the ones given in percent, and the value that stands
# for a text metric that could not be computed.
METRICS = (
    "bleu",
    "meteor",
    "rouge1",
    "rouge2",
    "rougeL",
    "semantic_similarity",
    "bertscore_f1",
    "judge_score",
)
TEXT_METRICS = METRICS[:5]
MISSING = -1.0


def score_samples(
    texts: DataFrame,
    vectors: DataFrame | None = None,
    tokens: Callable[[Column], Column] = words,
    classes: Sequence[DataFrame] = (),
) -> DataFrame:
    """Every per-sample number the corpus metrics are reduced from.

    ``texts`` has (sample_id, predicted, neutral); ``vectors`` may add, per
    sample, ``predicted_vec``/``neutral_vec`` and arrays of token vectors
    ``predicted_vecs``/``neutral_vecs``; ``tokens`` and ``classes`` go to METEOR. Texts are written once and read by each
    metric; all branches are partitioned by ``sample_id`` and join in place.
    """
    texts = stage(texts.select("sample_id", "predicted", "neutral"), "texts")
    scores = (
        overlap_by_sample(texts)
        .join(meteor_by_sample(texts, tokens=tokens, classes=classes).select("sample_id", "meteor"), "sample_id")
        .join(rouge_l_by_sample(texts), "sample_id")
    )
    if vectors is not None:
        scores = scores.join(vector_scores(vectors), "sample_id", "left")
    return scores


def evaluate(
    texts: DataFrame,
    judged: DataFrame | None = None,
    vectors: DataFrame | None = None,
    tokens: Callable[[Column], Column] = words,
    classes: Sequence[DataFrame] = (),
) -> DataFrame:
    """One row with the eight metrics; ``judged`` has (sample_id, score)."""
    scores = score_samples(texts, vectors, tokens, classes)
    if judged is not None:
        scores = scores.join(judged.select("sample_id", "score"), "sample_id", "left")

    def mean(column: str, present: bool) -> Column:
        return F.avg(column) if present else F.lit(None).cast("double")

    reduced = scores.agg(
        *bleu_sums(),
        F.avg("meteor").alias("meteor"),
        F.avg(rouge_f1(1)).alias("rouge1"),
        F.avg(rouge_f1(2)).alias("rouge2"),
        F.avg("rougeL").alias("rougeL"),
        mean("similarity", vectors is not None).alias("semantic_similarity"),
        mean("bertscore_f1", vectors is not None).alias("bertscore_f1"),
        mean("score", judged is not None).alias("judge_score"),
        F.count(F.lit(1)).alias("samples"),
    )
    bleu = F.when(F.col("samples") > 0, bleu_value())
    return metrics_record(reduced.withColumn("bleu", bleu))


def metrics_record(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Raw scores as the published record: percent, judge as is, missing as -1.

    A missing token-matching score counts as 0.
    """

    def shown(name: str) -> Column:
        if name in TEXT_METRICS:
            return F.coalesce(F.col(name) * 100, F.lit(MISSING))
        if name == "bertscore_f1":
            return F.coalesce(F.col(name), F.lit(0.0)) * 100
        return F.col(name) * 100 if name == "semantic_similarity" else F.col(name)

    return raw.select(*keep, *(shown(name).cast("double").alias(name) for name in METRICS))
