"""Judge and reward jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions.judging import RESULT_TYPE, judge_score, judge_valid
from tandem.functions.prompts import judge_messages
from tandem.functions.text import strip_think
from tandem.operators.enrich import MAX_CONCURRENT, Call, call_rows
from tandem.session import stage
from tandem.sources.logs import append_judge_scores


def judge(
    rows: DataFrame,
    call: Call,
    model: str,
    log_path: str | None = None,
    key: str = "sample_id",
    max_concurrent: int = MAX_CONCURRENT,
) -> DataFrame:
    """Score (biased, output, reference) rows.

    ``ok`` is false for a failed call and for scores out of range; such rows
    have ``score`` 0.0 and are not logged.
    """
    asked = rows.withColumn(
        "messages", judge_messages(F.col("biased"), F.col("output"), F.col("reference"))
    )
    answered = call_rows(asked, call, RESULT_TYPE, [key], max_concurrent, only_asked=["messages"])
    scored = stage(
        answered.withColumn("ok", F.col("ok") & judge_valid())
        .withColumn("score", F.when(F.col("ok"), judge_score()).otherwise(0.0))
        .withColumn("model", F.lit(model)),
        "judged",
    )
    if log_path:
        append_judge_scores(scored, log_path)
    return scored


def judge_mean(scored: DataFrame) -> DataFrame:
    """Mean over all rows with failures as 0.0, mean over usable rows, failures."""
    return scored.agg(
        F.avg("score").alias("judge_score"),
        F.avg(F.when(F.col("ok"), F.col("score"))).alias("judge_score_ok"),
        F.count_if(~F.col("ok")).alias("failures"),
    )


def reward_batch(rows: DataFrame, call: Call, model: str, log_path: str | None = None) -> DataFrame:
    """(sample_id, reward) for rows with ``completions``: message arrays.

    The first completion message is cleaned of reasoning and judged.
    """
    first = F.get("completions", F.lit(0))["content"]
    return judge(
        rows.select(
            "sample_id",
            "biased",
            strip_think(first).alias("output"),
            F.col("neutral").alias("reference"),
        ),
        call,
        model,
        log_path,
    ).select("sample_id", F.col("score").alias("reward"))
