"""Preference data for one training iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions.prompts import rank_messages
from tandem.functions.text import strip_think
from tandem.operators.builders import build_dpo
from tandem.operators.enrich import MAX_CONCURRENT, Call, call_rows, sample_responses
from tandem.operators.ranking import candidates, preference_pairs, rank_candidates, rank_rows
from tandem.operators.splits import BATCH_ROWS, assign_batches, batch_rows
from tandem.session import stage
from tandem.sources.logs import append_rankings

JUDGED_TYPE = "judged array<struct<id:int,rank:int>>, reasoning string"


def plan_iterations(pairs: DataFrame, size: int = BATCH_ROWS) -> DataFrame:
    """Preference prompts with their ``iteration`` and ``sample_idx``."""
    return assign_batches(build_dpo(pairs), size=size)


def plan_iteration(pairs: DataFrame, iteration: int, size: int = BATCH_ROWS) -> DataFrame:
    """The preference prompts of one iteration, from the key range of its pairs."""
    return build_dpo(batch_rows(pairs, iteration, size=size))


def rank_responses(
    rows: DataFrame, call: Call, key: str = "sample_id", max_concurrent: int = MAX_CONCURRENT
) -> DataFrame:
    """Judge the candidates of each row; failed calls keep the original order."""
    asked = rows.withColumn("messages", rank_messages(F.col("biased"), F.col("candidates")))
    answered = call_rows(asked, call, JUDGED_TYPE, [key], max_concurrent)
    return rank_candidates(stage(answered.drop("messages", "ok", "error"), "ranked"))


def iteration_pairs(
    planned: DataFrame,
    iteration: int,
    respond: Call,
    judge: Call,
    log_path: str | None = None,
    max_concurrent: int = MAX_CONCURRENT,
) -> DataFrame:
    """(sample_id, prompt, chosen, rejected): six rows per sample of one iteration.

    Iterations depend on the model trained by the one before, so they are run
    one at a time; the samples of one are independent.
    """
    batch = stage(planned.filter(F.col("iteration") == iteration), "iteration")
    responses = sample_responses(batch, respond, strip_think, max_concurrent=max_concurrent)
    ranked = rank_responses(
        batch.join(responses, "sample_id").withColumn(
            "candidates", candidates(F.col("neutral"), F.col("responses"))
        ),
        judge,
        max_concurrent=max_concurrent,
    )
    if log_path:
        append_rankings(rank_rows(ranked), log_path)
    return preference_pairs(ranked, keep=("sample_id", "formatted_prompt")).select(
        "sample_id", F.col("formatted_prompt").alias("prompt"), "chosen", "rejected"
    )
