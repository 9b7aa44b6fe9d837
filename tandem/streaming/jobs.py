"""Jobs that follow log files as they are written.

Each sink writes one folder per micro-batch and replaces it if the batch is
replayed, so a restart from the checkpoint does no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tandem.operators.enrich import MAX_CONCURRENT, Call, answered_rows, latest_by_key
from tandem.session import stage
from tandem.sources.keyed_log import KeyedLog

SALTS = 16


def follow(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files under ``path``."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def _folder_per_batch(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def running_judge_mean(scores: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep count, sum and failures per model of (model, score) rows.

    A null score is a failure and counts as 0.0. Rows combine before they are
    moved, so one busy model is no bottleneck.
    """
    totals = scores.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.coalesce("score", F.lit(0.0))).alias("total"),
        F.count_if(F.col("score").isNull()).alias("failures"),
    )
    return (
        totals.writeStream.outputMode("update")
        .foreachBatch(_folder_per_batch(out))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_judge_mean(spark: SparkSession, out: str) -> DataFrame:
    """The present mean and failure count of each model."""
    updates = spark.read.schema(
        "model string, rows bigint, total double, failures bigint, batch_id bigint"
    ).parquet(out)
    return latest_by_key(updates, ["model"], "batch_id").select(
        "model", "rows", (F.col("total") / F.col("rows")).alias("judge_score"), "failures"
    )


def dedupe_stream(
    rows: DataFrame, key: Sequence[str], time: str, delay: str, spread_by: Sequence[str]
) -> DataFrame:
    """The first row of each key within the lateness bound.

    Copies are first dropped per key and salt, then per key, so that a key with
    a third of the rows is not handled by one task.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).alias("_salt")
    return (
        rows.withWatermark(time, delay)
        .select("*", salt)
        .dropDuplicatesWithinWatermark([*key, "_salt"])
        .dropDuplicatesWithinWatermark(list(key))
        .drop("_salt")
    )


def latest_stream(
    rows: DataFrame, keys: Sequence[str], order: str, out: str, checkpoint: str
) -> StreamingQuery:
    """Keep the last row of each key: one row per key and micro-batch is written."""
    write = _folder_per_batch(out)

    def step(batch: DataFrame, batch_id: int) -> None:
        ranked = batch.withColumn("_order", F.col(order))
        write(latest_by_key(ranked, keys, "_order"), batch_id)

    return (
        rows.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_latest(spark: SparkSession, out: str, schema: str, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key over all micro-batches of ``latest_stream``."""
    rows = spark.read.schema(schema).parquet(out).withColumn("_order", F.col(order))
    return latest_by_key(rows, keys, "_order")


def write_stream(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows as Parquet."""
    return (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )


def enrich_stream(
    rows: DataFrame,
    key: str,
    call: Call,
    result: str,
    log_path: str,
    checkpoint: str,
    max_concurrent: int = MAX_CONCURRENT,
) -> StreamingQuery:
    """Call once for each new key of the stream and add the answers to the keyed log.

    A batch reads the buckets it touches and is one commit; a batch that is
    replayed after its commit does nothing. Failed keys are not logged, and are
    asked again when they next appear.
    """
    key_type = rows.schema[key].dataType.simpleString()
    fields = T.StructType.fromDDL(result).names

    def step(batch: DataFrame, batch_id: int) -> None:
        log = KeyedLog(batch.sparkSession, log_path, key, key_type, result)
        if log.holds_batch(batch_id):
            return
        keys = stage(log.hashed(batch.select(key).where(F.col(key).isNotNull())).dropDuplicates(["_hash"]), "keys")
        answered = answered_rows(log.missing(keys).select(key), call, result, [key], max_concurrent)
        log.append(answered.select(key, *fields), batch_id)

    return (
        rows.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_enriched(spark: SparkSession, log_path: str, key_type: str, key: str, result: str) -> DataFrame:
    """Answers logged by ``enrich_stream``, the latest per key."""
    fields = T.StructType.fromDDL(result).names
    return KeyedLog(spark, log_path, key, key_type, result).latest().select(key, *fields)
