"""Classifier scores, loss summaries and a text classifier."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.text import words
from tandem.operators.builders import label_texts
from tandem.operators.skew import lookup_join
from tandem.session import stage

# Passes over the data, and the step between logged losses.
EPOCHS, LOG_EVERY = 3, 10


def accuracy(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg((F.col("label") == F.col("pred")).cast("int")).alias("accuracy"))


def class_counts(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class (of each group of ``by``): true positives, predicted and actual rows.

    Rows are first counted per (label, pred); only that small table is unfolded.
    """
    confusion = scored.groupBy(*by, "label", "pred").agg(F.count(F.lit(1)).alias("rows"))

    def seen(column: str, actual: bool) -> Column:
        hit = F.col("label") == F.col("pred")
        return F.struct(
            F.col(column).alias("class"),
            F.when(hit & F.lit(actual), F.col("rows")).otherwise(F.lit(0)).alias("tp"),
            F.when(F.lit(not actual), F.col("rows")).otherwise(F.lit(0)).alias("predicted"),
            F.when(F.lit(actual), F.col("rows")).otherwise(F.lit(0)).alias("support"),
        )

    unfolded = confusion.select(*by, F.inline(F.array(seen("label", True), seen("pred", False))))
    return unfolded.groupBy(*by, "class").agg(
        *(F.sum(name).alias(name) for name in ("tp", "predicted", "support"))
    )


def _weighted_f1() -> Column:
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("predicted") + F.col("support")))
    return F.sum(F.coalesce(f1, F.lit(0.0)) * F.col("support")) / F.sum("support")


def weighted_f1(scored: DataFrame) -> DataFrame:
    """F1 per class, averaged by the class's share of the labels."""
    return class_counts(scored).agg(_weighted_f1().alias("f1"))


def scores_by(scored: DataFrame, by: str) -> DataFrame:
    """(by, val_accuracy, val_f1): accuracy and weighted F1 of each group, as of each epoch, in one reading."""
    correct = (F.sum("tp") / F.sum("support")).alias("val_accuracy")
    return class_counts(scored, [by]).groupBy(by).agg(correct, _weighted_f1().alias("val_f1"))


def loss_summary(steps: DataFrame, every: int = LOG_EVERY) -> DataFrame:
    """Mean loss per epoch, and the loss of every tenth step, as (kind, at, loss)."""
    epochs = steps.groupBy("epoch").agg(F.avg("loss").alias("loss"))
    return epochs.select(F.lit("epoch").alias("kind"), F.col("epoch").alias("at"), "loss").unionByName(
        steps.filter(F.col("step") % every == 0).select(
            F.lit("step").alias("kind"), F.col("step").alias("at"), "loss"
        )
    )


def hold_out(pairs: DataFrame, share: float = 0.1, key: str = "sample_id"):
    """(train, held out) by a hash of the key, so both texts of a pair stay together."""
    buckets = 1000
    held = F.crc32(F.col(key).cast("string").cast("binary")) % buckets < int(share * buckets)
    return pairs.filter(~held), pairs.filter(held)


#: Step of a gradient pass, and the documents of the training set a word must be in.
LEARNING_RATE, LEAST_TEXTS = 0.5, 2


def _word_shares(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rows, shares): the words of a text, each occurrence with its share of the text's words; texts of equal keys in one row."""
    listed = texts.select(*keys, words(F.col("text")).alias("_words"))
    shares = F.transform("_words", lambda w: F.struct(w.alias("word"), (1.0 / F.size("_words")).alias("x")))
    return listed.select(*keys, shares.alias("_shares")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.flatten(F.collect_list("_shares")).alias("shares")
    )


def _margins(shares: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rows, margin) of every row of ``shares``; null without a word that has a weight, or without a key."""
    unfolded = shares.select(*keys, "rows", F.explode_outer("shares").alias("_t")).select(*keys, "rows", "_t.*")
    margin = F.when(F.col(keys[0]).isNotNull(), F.sum(F.col("x") * F.col("weight")))
    found = lookup_join(unfolded, weights, ["word"], spread_by=[*keys, "x"])
    return found.groupBy(*keys).agg(F.max("rows").alias("rows"), margin.alias("margin"))


@dataclass(frozen=True)
class TextClassifier:
    """A weight for each counted word, and a constant."""

    weights: DataFrame
    constant: float


def train_text_classifier(
    pairs: DataFrame, passes: int = EPOCHS, rate: float = LEARNING_RATE, least_texts: int = LEAST_TEXTS, key: str = "sample_id"
) -> TextClassifier:
    """Source-versus-rewrite logistic regression by ``passes`` full-batch gradient steps.

    Features are the words that at least ``least_texts`` training texts hold,
    counted exactly, each text's shares summing to 1 over all its words. A pass
    is one aggregation of margins by text and one of gradients by word; weights
    are a table, joined by word, so that neither words nor texts have a bound.
    The words of a text stay in its row, and are unfolded where they are summed.
    """
    keys = [key, "label"]
    shares = stage(_word_shares(label_texts(pairs).select(*keys, "text"), keys), "classifier-shares")
    rows = shares.agg(F.sum("rows")).first()[0] or 0
    held = shares.select(F.explode(F.array_distinct("shares.word")).alias("word"))
    known = held.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_texts).select("word")
    weights = stage(known.withColumn("weight", F.lit(0.0)), "classifier-weights")
    constant = 0.0
    for _ in range(passes):
        chance = 1 / (1 + F.exp(-(F.coalesce("margin", F.lit(0.0)) + constant)))
        scored = _margins(shares, weights, keys)
        apart = stage(scored.select(*keys, (F.col("rows") * (chance - F.col("label"))).alias("apart")), "classifier-apart")
        unfolded = shares.join(apart, keys).select("apart", F.explode("shares").alias("_t"))
        slopes = unfolded.groupBy("_t.word").agg(F.sum(F.col("_t.x") * F.col("apart")).alias("slope"))
        moved = F.col("weight") - F.lit(rate / max(rows, 1)) * F.col("slope")
        weights = stage(weights.join(slopes, "word").select("word", moved.alias("weight")), "classifier-weights")
        constant -= rate / max(rows, 1) * (apart.agg(F.sum("apart")).first()[0] or 0.0)
    return TextClassifier(weights, constant)


def classify_pairs(model: TextClassifier, pairs: DataFrame, key: str = "sample_id") -> DataFrame:
    """(sample_id, label, margin, pred) for both texts of each pair; words without a weight count in the shares alone."""
    texts = label_texts(pairs).select(key, "label", "text")
    keys = [key, "label"]
    margins = _margins(_word_shares(texts, keys), model.weights, keys).drop("rows")
    margin = (F.coalesce("margin", F.lit(0.0)) + F.lit(model.constant)).alias("margin")
    return texts.select(*keys).join(margins, keys, "left").select(*keys, margin, (F.coalesce("margin", F.lit(0.0)) + F.lit(model.constant) >= 0).cast("int").alias("pred"))
