"""Evaluation of a model from its test split to the run log, as one restartable job."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.prompts import CHATML, ChatTags, inference_messages, render_chat
from tandem.functions.text import words
from tandem.operators.enrich import PREDICT_BATCH, Call, predicted_rows
from tandem.operators.ordinals import with_ordinals
from tandem.operators.splits import split_pairs
from tandem.plans.evaluate import METRICS, evaluate
from tandem.plans.judging import judge
from tandem.plans.runs import Run
from tandem.sources.logs import metrics_long, scan_predictions, slug, write_predictions, write_run

KEY = "sample_id"


def inference_prompt(text: Column, tags: ChatTags = CHATML) -> Column:
    """The rendered request for one text, opened for an answer without reasoning."""
    return render_chat(inference_messages(text), generation_prompt=True, thinking_off=True, tags=tags)


def predict_chats(
    pairs: DataFrame,
    predict: Callable[[list[str]], list[str]],
    size: int = PREDICT_BATCH,
    tags: ChatTags = CHATML,
) -> DataFrame:
    """Add ``predicted``: rendered requests go to ``predict`` in lists of ``size``."""
    asked = pairs.withColumn("prompt", inference_prompt(F.col("biased"), tags))
    return predicted_rows(asked, predict, "prompt", size).drop("prompt")


def existing_predictions(test: DataFrame, path: str) -> DataFrame:
    """Test rows with the predictions of a file, whose rows are in ``sample_id`` order."""
    numbered = with_ordinals(test, [KEY], "row_idx")
    return numbered.join(scan_predictions(test.sparkSession, path), "row_idx").drop("row_idx")


def eval_model(
    pairs: DataFrame,
    folder: str,
    model: str,
    predict: Callable[[list[str]], list[str]] | None,
    judge_call: Call,
    judge_model: str,
    base_model: str = "",
    vectors: Callable[[DataFrame], DataFrame] | None = None,
    existing: str | None = None,
    tokens: Callable[[Column], Column] = words,
    classes: Sequence[DataFrame] = (),
    sizes: Mapping[str, int] | None = None,
) -> DataFrame:
    """Evaluate ``model`` on the test split of ``pairs``; returns the rows of its run log.

    Steps: test split, predictions (by ``predict``, or read from the file
    ``existing``), prediction file, judgements, vectors (by ``vectors``, from the
    predictions), metrics, run log. Each is written under ``folder``, which
    belongs to this evaluation; a run that was ended goes on after its last finished step, and
    no call of a finished step is repeated. The prediction file and the log rows
    are replaced when they are written again, never doubled.
    """
    spark = pairs.sparkSession
    run, name = Run(spark, folder), f"eval_{model.replace('/', '_')}"
    settings = {"model": model, "base_model": base_model}
    test = run.step("test", lambda: split_pairs(pairs, "test", **(sizes or {})).select(KEY, "biased", "neutral"), dict(sizes or {}))

    def predictions() -> DataFrame:
        return predict_chats(test, predict) if existing is None else existing_predictions(test, existing)

    predicted = run.step("predictions", predictions, {**settings, "existing": existing}, ["test"])
    file = f"{run.folder}/predictions/{slug(model)}"
    if existing is None:
        run.effect("file", lambda: write_predictions(predicted.orderBy(KEY), file), settings, ["predictions"])
    judged = run.step(
        "judged",
        lambda: judge(
            predicted.select(KEY, "biased", F.col("predicted").alias("output"), F.col("neutral").alias("reference")),
            judge_call,
            judge_model,
        ).select(KEY, "score", "ok"),
        {"judge": judge_model},
        ["predictions"],
    )
    needs = ["predictions", "judged"]
    embedded = None
    if vectors is not None:
        embedded = run.step("vectors", lambda: vectors(predicted), {}, ["predictions"])
        needs.append("vectors")
    scores = run.step("metrics", lambda: evaluate(predicted, judged, embedded, tokens, classes), {"classes": len(classes)}, needs)
    params = {"checkpoint_path": model, "base_model_name": base_model, "judge_model_name": judge_model}
    if existing is None:
        params["test_dataset_size"] = str(test.count())
    rows = metrics_long(scores, F.lit(name), params, {"task": "evaluation"}, METRICS)
    log = f"{run.folder}/run_log"
    run.effect("log", lambda: write_run(rows, log, name), {**settings, "params": params}, ["metrics"])
    return spark.read.schema(rows.schema).parquet(log)
