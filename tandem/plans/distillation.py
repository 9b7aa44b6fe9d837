"""Teacher answers to distillation losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.prompts import teacher_messages
from tandem.functions.text import chat_tokens
from tandem.operators.distil import (
    ALPHA,
    TEMPERATURE,
    mixed_loss,
    position_losses,
    sample_losses,
)
from tandem.operators.enrich import MAX_CONCURRENT, Call, cached_enrich
from tandem.operators.skew import lookup_join
from tandem.sources.logs import LOGPROBS_TYPE

TEACHER_RESULT = f"neutralized_text string, logprobs {LOGPROBS_TYPE}, model string"


def teacher_answers(
    pairs: DataFrame, log_path: str, call: Call, max_concurrent: int = MAX_CONCURRENT
) -> DataFrame:
    """Pairs with teacher logprobs, asking only for texts the log lacks.

    The call sees the text and its chat ``messages``. A failed text has an empty
    list and is asked again next time.
    """
    answered = cached_enrich(
        pairs,
        "biased",
        log_path,
        call,
        TEACHER_RESULT,
        ["sample_id"],
        max_concurrent,
        asked_with={"messages": teacher_messages(F.col("biased"))},
    )
    empty = F.expr(f"cast(array() as {LOGPROBS_TYPE})")
    return answered.withColumn("logprobs", F.coalesce("logprobs", empty))


def with_token_ids(responses: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Teacher rows (sample_id, pos, chosen, top) with tokens replaced by ids.

    A teacher token is cut as texts are and stands for its first piece, so that a
    leading space or a longer token finds its id. Without a piece, or with one
    outside ``vocabulary`` (token, token_id), the id is null.
    """
    ids = vocabulary.select(F.col("token").alias("piece"), F.col("token_id").cast("int").alias("token_id"))

    def entry(c: Column) -> Column:
        return F.struct(c["token"].alias("token"), c["logprob"].alias("logprob"))

    others = F.coalesce(F.transform("r.top_logprobs", entry), F.expr("cast(array() as array<struct<token:string,logprob:double>>)"))
    found = (
        responses.select("sample_id", F.posexplode("logprobs").alias("pos", "r"))
        .select("sample_id", "pos", F.posexplode(F.concat(F.array(entry(F.col("r"))), others)).alias("at", "e"))
        .select("sample_id", "pos", "at", F.get(chat_tokens(F.col("e.token")), F.lit(0)).alias("piece"), "e.logprob")
    )
    found = lookup_join(found, ids, ["piece"], spread_by=["sample_id", "pos", "at"])
    entries = F.sort_array(F.collect_list(F.struct("at", F.col("token_id").alias("token"), "logprob")))
    shown = F.transform(entries, lambda e: F.struct(e["token"].alias("token"), e["logprob"].alias("logprob")))
    rows = found.groupBy("sample_id", "pos").agg(shown.alias("_all"))
    return rows.select(
        "sample_id",
        "pos",
        F.get("_all", F.lit(0)).alias("chosen"),
        F.slice("_all", 2, F.size("_all")).alias("top"),
    )


def distillation_losses(
    teacher: DataFrame,
    student: DataFrame,
    labels: DataFrame,
    hard: DataFrame,
    temperature: float = TEMPERATURE,
    alpha: float = ALPHA,
) -> DataFrame:
    """(sample_id, kl, hard, loss) for every sample of ``hard`` (sample_id, hard)."""
    positions = position_losses(teacher, student, labels, temperature)
    kl = sample_losses(positions, hard, temperature)
    return hard.join(kl, "sample_id", "left").withColumn(
        "loss", mixed_loss(F.col("kl"), F.col("hard"), alpha)
    )
