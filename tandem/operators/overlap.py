"""N-gram overlap of predictions with references: BLEU and ROUGE-N."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.text import tokens_13a, words
from tandem.operators.skew import placed_by

BLEU_ORDERS = (1, 2, 3, 4)
ROUGE_ORDERS = (1, 2)

# name -> (tokeniser, n-gram orders from 1 up)
FAMILIES = {"bleu": (tokens_13a, BLEU_ORDERS), "rouge": (words, ROUGE_ORDERS)}


def overlap_by_sample(
    texts: DataFrame, key: str = "sample_id", families: Sequence[str] = tuple(FAMILIES)
) -> DataFrame:
    """Per sample: matched, predicted and reference n-grams of every family and order.

    ``texts`` holds ``key``, ``predicted`` and ``neutral``. Texts are moved to
    their key once; tokens, and the n-grams built from each and its successors,
    stay where they are made (the window and both groupings start with ``key``).
    """
    placed = placed_by(texts.select(key, "predicted", "neutral"), key)

    def tokens(family: int, text: str) -> Column:
        return F.transform(
            FAMILIES[families[family]][0](F.col(text)),
            lambda token, pos: F.struct(
                F.lit(family).alias("family"),
                F.lit(text == "predicted").alias("predicted"),
                pos.alias("pos"),
                token.alias("token"),
            ),
        )

    sides = [(f, text) for f in range(len(families)) for text in ("predicted", "neutral")]
    # The outer form keeps samples without a token, as one row of nulls.
    rows = placed.select(
        key, F.explode_outer(F.concat(*(tokens(*side) for side in sides))).alias("t")
    ).select(key, "t.*")

    in_order = Window.partitionBy(key, "family", "predicted").orderBy("pos")
    orders = {f: FAMILIES[name][1] for f, name in enumerate(families)}
    gram, grams = F.col("token"), []
    for n in range(1, max(max(wanted) for wanted in orders.values()) + 1):
        if n > 1:
            gram = F.concat(gram, F.lit(" "), F.lead("token", n - 1).over(in_order))
        used = F.col("family").isin(*(f for f, wanted in orders.items() if n in wanted))
        grams.append((n, gram if n == 1 else F.when(used, gram)))
    with_grams = rows.select(
        key, "family", "predicted", *(column.alias(f"gram{n}") for n, column in grams)
    )
    unfolded = F.array(
        *(F.struct(F.lit(n).alias("n"), F.col(f"gram{n}").alias("gram")) for n, _ in grams)
    )
    counts = (
        with_grams.select(key, "family", "predicted", F.inline(unfolded))
        .filter(F.col("gram").isNotNull() | (F.col("n") == 1))
        .groupBy(key, "family", "n", "gram")
        .agg(F.count_if(F.col("predicted")).alias("p"), F.count_if(~F.col("predicted")).alias("r"))
    )

    def total(value: Column, family: int, n: int, part: str) -> Column:
        here = (F.col("family") == family) & (F.col("n") == n)
        named = f"{families[family]}{n}_{part}"
        return F.sum(F.when(here, value).otherwise(F.lit(0))).alias(named)

    sums = []
    for family, wanted in orders.items():
        for n in wanted:
            sums += [
                total(F.least("p", "r"), family, n, "matched"),
                total(F.col("p"), family, n, "predicted"),
                total(F.col("r"), family, n, "reference"),
            ]
    return counts.groupBy(key).agg(*sums)


def bleu_sums() -> list[Column]:
    """Corpus sums of every order, as aggregates over ``overlap_by_sample``."""
    return [
        F.coalesce(F.sum(f"bleu{n}_{part}"), F.lit(0)).alias(f"bleu{n}_{part}")
        for n in BLEU_ORDERS
        for part in ("matched", "predicted", "reference")
    ]


def bleu_statistics(by_sample: DataFrame) -> DataFrame:
    """One row per order: (n, matched, total, reference)."""
    rows = F.array(
        *(
            F.struct(
                F.lit(n).cast("bigint").alias("n"),
                F.col(f"bleu{n}_matched").alias("matched"),
                F.col(f"bleu{n}_predicted").alias("total"),
                F.col(f"bleu{n}_reference").alias("reference"),
            )
            for n in BLEU_ORDERS
        )
    )
    return by_sample.agg(*bleu_sums()).select(F.inline(rows))


def bleu_value() -> Column:
    """BLEU in [0, 1] from the corpus sums, without smoothing."""
    matched = [F.col(f"bleu{n}_matched") for n in BLEU_ORDERS]
    possible = [F.col(f"bleu{n}_predicted") for n in BLEU_ORDERS]
    predicted, reference = F.col("bleu1_predicted"), F.col("bleu1_reference")
    logs = sum((F.log(m / t) for m, t in zip(matched, possible)), F.lit(0.0))
    brevity = F.when(predicted > reference, 1.0).otherwise(F.exp(1.0 - reference / predicted))
    value = brevity * F.exp(logs / len(BLEU_ORDERS))
    return F.when(F.least(*matched) > 0, value).otherwise(0.0)


def bleu(by_sample: DataFrame) -> DataFrame:
    return by_sample.agg(*bleu_sums()).select(bleu_value().alias("bleu"))


def f1(matched: Column, predicted: Column, reference: Column) -> Column:
    """Harmonic mean of precision and recall; 0 where nothing matches."""
    return F.when(matched > 0, 2.0 * matched / (predicted + reference)).otherwise(0.0)


def rouge_f1(n: int) -> Column:
    return f1(*(F.col(f"rouge{n}_{part}") for part in ("matched", "predicted", "reference")))


def rouge_n(by_sample: DataFrame) -> DataFrame:
    """Mean ROUGE-1 and ROUGE-2 F1 over samples."""
    return by_sample.agg(*(F.avg(rouge_f1(n)).alias(f"rouge{n}") for n in ROUGE_ORDERS))
