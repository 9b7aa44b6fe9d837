"""Resumable generation of reasoning records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions.prompt_texts import COT_STYLE
from tandem.functions.prompts import cot_prompt
from tandem.operators.enrich import MAX_CONCURRENT, Call, answered_rows, pending_commits, resume
from tandem.sources.logs import append_cot, iso_now, scan_cot

RECORD = ("timestamp", "input", "style", "prompt", "response", "model")


def requests(pairs: DataFrame) -> DataFrame:
    """What is asked about each pair."""
    return pairs.select(
        "sample_id",
        F.col("biased").alias("input"),
        F.lit(COT_STYLE).alias("style"),
        cot_prompt(F.col("biased")).alias("prompt"),
    )


def records(answered: DataFrame, model: str) -> DataFrame:
    return answered.select(
        iso_now().alias("timestamp"), "input", "style", "prompt", "response", F.lit(model).alias("model")
    )


def increment(
    pairs: DataFrame,
    log: DataFrame,
    call: Call,
    model: str,
    max_concurrent: int = MAX_CONCURRENT,
) -> DataFrame:
    """Records for the source texts that the log does not hold yet."""
    return records(resume(requests(pairs), log, "input", call, "response string", ["sample_id"], max_concurrent), model)


def generate(
    pairs: DataFrame,
    log_path: str,
    call: Call,
    model: str,
    max_concurrent: int = MAX_CONCURRENT,
    commits: int = 4,
) -> DataFrame:
    """Extend the log at ``log_path`` and return all of it.

    The pairs and the log are read once, before the first call; what is missing
    is written with a commit number, a hash of the text. Each of the ``commits`` parts is
    appended when done, so rows that repeat a text are asked and appended
    together; a run that stops is taken up again from the last append.
    """
    spark = pairs.sparkSession
    pending = pending_commits(requests(pairs), scan_cot(spark, log_path), "input", commits)
    for at in range(commits):
        rows = pending.where(F.col("_commit") == at).drop("_commit")
        answered = answered_rows(rows, call, "response string", ["sample_id"], max_concurrent)
        append_cot(records(answered, model), log_path)
    return scan_cot(spark, log_path)


def union_records(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Logged records and new ones together."""
    return existing.select(*RECORD).unionByName(new.select(*RECORD))
