"""Prediction files and the append-only logs of models, judges and runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tandem.functions.judging import SCORES, judge_total
from tandem.functions.text import path_slug
from tandem.operators.ordinals import with_file_ordinals

# File layouts.
PREDICTION_SCHEMA = "biased string, neutral string, predicted string"
LOGPROBS_TYPE = (
    "array<struct<token:string,logprob:double,"
    "top_logprobs:array<struct<token:string,logprob:double>>>>"
)
TEACHER_SCHEMA = (
    "timestamp string, biased_text string, neutralized_text string, "
    f"logprobs {LOGPROBS_TYPE}, model string"
)
COT_SCHEMA = (
    "timestamp string, input string, style string, prompt string, response string, model string"
)
JUDGE_COLUMNS = ("model_output", *SCORES, "total_score", "biased_text", "reference_text", "overall_reasoning")

_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``row_idx`` and ``predicted`` (third column) of prediction CSV, in file order."""
    rows = spark.read.schema(PREDICTION_SCHEMA).options(**_CSV).csv(path)
    return with_file_ordinals(rows).select("row_idx", "predicted")


def write_predictions(df: DataFrame, path: str) -> None:
    """Replace the prediction files; quotes are doubled, line ends may be inside."""
    columns = df.select("biased", "neutral", "predicted")
    columns.write.mode("overwrite").options(**_CSV, quoteAll="true", emptyValue="").csv(path)


def scan_teacher(spark: SparkSession, path: str, counts: Observation | None = None) -> DataFrame:
    """Usable teacher answers; blank, broken and empty records are skipped.

    ``counts`` is given, as the rows are read, the lines that were ``blank``,
    ``broken`` (no JSON record), ``empty`` (no text or no list) and ``used``. A path
    that does not exist gives no rows.
    """
    bad = "_broken string"
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string")
    blank = F.trim("value") == ""
    options = {"columnNameOfCorruptRecord": "_broken"}
    rows = lines.select(F.from_json("value", f"{TEACHER_SCHEMA}, {bad}", options).alias("r"), blank.alias("_blank"))
    rows = rows.select("r.*", "_blank")
    broken = ~F.col("_blank") & F.col("_broken").isNotNull()
    used = ~F.col("_blank") & ~broken & F.coalesce((F.col("biased_text") != "") & (F.size("logprobs") > 0), F.lit(False))
    rows = rows.withColumns({"_bad": broken, "_used": used})
    if counts is not None:
        rows = rows.observe(
            counts,
            F.count_if("_blank").alias("blank"),
            F.count_if("_bad").alias("broken"),
            F.count_if(~F.col("_blank") & ~F.col("_bad") & ~F.col("_used")).alias("empty"),
            F.count_if("_used").alias("used"),
        )
    return rows.filter("_used").drop("_blank", "_broken", "_bad", "_used")


def append_teacher(df: DataFrame, path: str) -> None:
    """Append answers as JSON lines stamped with the time of writing."""
    (
        df.withColumn("timestamp", iso_now())
        .select("timestamp", "biased_text", "neutralized_text", "logprobs", "model")
        .write.mode("append")
        .option("ignoreNullFields", "false")
        .json(path)
    )


def scan_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet log, or no rows where it has not been started."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_cot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a reasoning log; a line that is not JSON fails the read."""
    try:
        return spark.read.schema(COT_SCHEMA).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COT_SCHEMA)


def append_cot(df: DataFrame, path: str) -> None:
    """Append reasoning records as one commit, leaving earlier files alone."""
    df.select("timestamp", "input", "style", "prompt", "response", "model").write.mode(
        "append"
    ).json(path)


def judge_rows(scored: DataFrame) -> DataFrame:
    """Judge log rows: usable judgements only, with their computed total."""
    return scored.filter("ok").select(
        F.col("output").alias("model_output"),
        *SCORES,
        judge_total().alias("total_score"),
        F.col("biased").alias("biased_text"),
        F.col("reference").alias("reference_text"),
        "overall_reasoning",
        path_slug(F.col("model")).alias("model_slug"),
    )


def append_judge_scores(scored: DataFrame, path: str) -> None:
    """Append judge rows, one folder per model."""
    judge_rows(scored).write.mode("append").partitionBy("model_slug").parquet(path)


def append_judge_csv(scored: DataFrame, path: str) -> None:
    """The same rows as CSV files with a header each."""
    judge_rows(scored).select(*JUDGE_COLUMNS).write.mode("append").options(
        **_CSV, quoteAll="true"
    ).csv(path)


def append_rankings(ranked: DataFrame, path: str) -> None:
    """Append ranked candidates, one folder per iteration."""
    ranked.write.mode("append").partitionBy("iteration").parquet(path)


def metrics_long(
    rows: DataFrame,
    run: Column,
    params: Mapping[str, str],
    tags: Mapping[str, str],
    metrics: Sequence[str],
    step: Column | None = None,
) -> DataFrame:
    """Metric columns and run settings as rows (run, kind, key, step, number, text).

    ``rows`` holds one row per run, or per run and ``step`` (an epoch, a training
    step). Numbers are kept in ``number``, settings in ``text``; settings have no
    step and are given once per run.
    """
    none_text, none_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    no_step = F.lit(None).cast("bigint")
    at = no_step if step is None else step.cast("bigint")

    def entry(kind: str, key: str, at: Column, number: Column, text: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(key).alias("key"),
            at.alias("step"),
            number.alias("number"),
            text.alias("text"),
        )

    settings = [
        *(entry("param", k, no_step, none_number, F.lit(v)) for k, v in params.items()),
        *(entry("tag", k, no_step, none_number, F.lit(v)) for k, v in tags.items()),
    ]
    measured = rows.select(
        run.alias("run"),
        F.inline(F.array(*(entry("metric", k, at, F.col(k).cast("double"), none_text) for k in metrics))),
    )
    if not settings:
        return measured
    runs = rows.select(run.alias("run"))
    if step is not None:
        runs = runs.distinct()
    return runs.select("run", F.inline(F.array(*settings))).unionByName(measured)


def append_run_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("run").parquet(path)


def write_run(rows: DataFrame, path: str, run: str) -> None:
    """The rows of one run, in place of what the log at ``path`` holds of it."""
    folder = f"{path}/run={quote(run, safe='')}"
    rows.drop("run").coalesce(1).write.mode("overwrite").parquet(folder)


def slug(name: str) -> str:
    """``path_slug`` of a known name."""
    return name.translate(str.maketrans("/ ", "__", "."))


def iso_now() -> Column:
    """The time of the job as an ISO-8601 string."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
