"""Jobs around outside functions: bounded calls, resume, caching, failure policy.

An outside function takes one row as a dict and returns a dict of results, or
None. An exception and None both count as a failure. Results are always written
to a table before anything reads them, so no retry repeats a call whose result
has been committed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tandem.session import stage
from tandem.sources.keyed_log import KeyedLog, key_hash

# Calls in flight, rows that a worker holds as Python objects at once,
# sampling temperatures, prediction batch, characters of text shown in an error.
MAX_CONCURRENT = 20
HELD_ROWS = 256
TEMPERATURES = (0.7, 1.0, 1.5)
PREDICT_BATCH = 16
ERROR_PREFIX = 50

Call = Callable[[dict], dict | None]


def held(batches: Iterator[pa.RecordBatch], rows: int = HELD_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def call_rows(
    df: DataFrame,
    call: Call,
    result: str,
    key: Sequence[str],
    max_concurrent: int = MAX_CONCURRENT,
    only_asked: Sequence[str] = (),
) -> DataFrame:
    """Add the result fields, ``ok`` and ``error`` to every row.

    At most ``max_concurrent`` calls run at once over the whole job: rows are
    spread by ``key`` over that many tasks or fewer, each with its share. The
    columns of ``df`` pass through as Arrow arrays, unchanged, but for those of
    ``only_asked``, which the call sees and the result lacks. A worker turns
    ``HELD_ROWS`` rows of a batch into Python objects at a time.
    """
    tasks = max(1, min(max_concurrent, df.sparkSession.sparkContext.defaultParallelism))
    in_flight = max(1, max_concurrent // tasks)
    fields = T.StructType.fromDDL(result)
    names = [field.name for field in fields]
    kept = [at for at, name in enumerate(df.columns) if name not in only_asked]
    schema = T.StructType(
        [*(df.schema.fields[at] for at in kept), *fields.fields]
        + [T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())]
    )
    key = list(key)
    added = to_arrow_schema(T.StructType(schema.fields[len(kept) :]))

    def attempt(row: dict) -> dict:
        try:
            answer = call(row)
        except Exception as failure:
            shown = str([str(row[k])[:ERROR_PREFIX] for k in key])
            return {"ok": False, "error": f"{shown}: {failure}"}
        if answer is None:
            return {"ok": False, "error": "no answer"}
        return {**answer, "ok": True, "error": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in held(batches):
                answers = list(pool.map(attempt, batch.to_pylist()))
                found = [pa.array([answer.get(f.name) for answer in answers], f.type) for f in added]
                yield pa.RecordBatch.from_arrays([*(batch.column(at) for at in kept), *found], schema.names)

    return df.repartition(tasks, *key).mapInArrow(run, schema)


def latest_by_key(log: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key; which one of equal last rows, is left open.

    Only hashes and orders are grouped; the rows find theirs in a hash join, unsorted.
    """
    hashed = log.withColumn("_hash", key_hash(*keys))
    last = hashed.groupBy("_hash").agg(F.max(order).alias("_last"))
    found = hashed.join(last.hint("shuffle_hash"), "_hash").where(F.col(order) >= F.col("_last"))
    return found.dropDuplicates(["_hash"]).select(*keys, *(c for c in log.columns if c not in (*keys, order)))


def not_logged(source: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Source rows whose key is not in the log; equal source rows all stay.

    Keys are compared by their 128-bit hashes. A frequent key is a single row
    of the log's side, and the rows of the other are split by adaptive execution.
    """
    held = log.select(key_hash(key).alias("_hash")).distinct()
    return source.withColumn("_hash", key_hash(key)).join(held, "_hash", "left_anti").drop("_hash")


def pending_commits(source: DataFrame, log: DataFrame, key: str, commits: int) -> DataFrame:
    """The unlogged rows with the number of their commit, ``_commit``, found and written once."""
    pending = not_logged(source, log, key)
    return stage(pending.withColumn("_commit", F.pmod(F.xxhash64(key), F.lit(commits))), "pending")


def answered_rows(
    pending: DataFrame, call: Call, result: str, spread_by: Sequence[str], max_concurrent: int = MAX_CONCURRENT
) -> DataFrame:
    """Results of rows. Failures are left out, so a later run retries them."""
    answered = call_rows(pending, call, result, spread_by, max_concurrent)
    return stage(answered.filter("ok").drop("ok", "error"), "resume")


def resume(
    source: DataFrame,
    log: DataFrame,
    key: str,
    call: Call,
    result: str,
    spread_by: Sequence[str],
    max_concurrent: int = MAX_CONCURRENT,
) -> DataFrame:
    """Results for unlogged rows. Failures are left out, so a later run retries them."""
    return answered_rows(not_logged(source, log, key), call, result, spread_by, max_concurrent)


def cached_enrich(
    source: DataFrame,
    key: str,
    log_path: str,
    call: Call,
    result: str,
    spread_by: Sequence[str] = (),
    max_concurrent: int = MAX_CONCURRENT,
    commits: int = 1,
    asked_with: dict[str, Column] | None = None,
) -> DataFrame:
    """``source`` with result fields, calling only for keys the log lacks.

    Each missing key is called once and appended to the keyed log at
    ``log_path``; failed keys are not logged and come back as nulls. The missing
    keys are found in one reading of the source and of the buckets it touches, and written with the
    number of their commit; each commit is appended when done. The call
    sees the key and the columns of ``asked_with``, which are made from it.
    """
    log = KeyedLog(source.sparkSession, log_path, key, source.schema[key].dataType.simpleString(), result)
    keys = log.hashed(source.select(key).where(F.col(key).isNotNull())).dropDuplicates(["_hash"])
    part = F.pmod(F.xxhash64("_hash"), F.lit(commits))
    keys = stage(keys, "keys")
    touched = log.touched(keys)
    pending = stage(log.missing(keys, touched).withColumn("_commit", part), "pending")
    fields = T.StructType.fromDDL(result).names
    for at in range(commits):
        asked = pending.where(F.col("_commit") == at).select(key).withColumns(asked_with or {})
        log.append(answered_rows(asked, call, result, [key], max_concurrent).select(key, *fields))
    cache = log.latest(touched).select("_hash", *fields)
    return log.hashed(source).join(cache, "_hash", "left").drop("_hash")


def fan_out(df: DataFrame, temperatures: Sequence[float] = TEMPERATURES) -> DataFrame:
    """One row per source row and sampling temperature."""
    settings = F.array(*(F.lit(float(t)) for t in temperatures))
    return df.select("*", F.posexplode(settings).alias("temp_idx", "temperature"))


def collect_samples(fanned: DataFrame, key: str = "sample_id", response: str = "response") -> DataFrame:
    """``responses`` of each key in temperature order, one entry per temperature."""
    return fanned.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("temp_idx", F.col(response).alias("text")))),
            lambda entry: entry["text"],
        ).alias("responses")
    )


def sample_responses(
    prompts: DataFrame,
    call: Call,
    clean: Callable[[Column], Column],
    key: str = "sample_id",
    temperatures: Sequence[float] = TEMPERATURES,
    max_concurrent: int = MAX_CONCURRENT,
) -> DataFrame:
    """(key, responses): each prompt answered at every temperature and cleaned."""
    answered = stage(
        call_rows(
            fan_out(prompts, temperatures), call, "response string", [key, "temp_idx"], max_concurrent
        ),
        "samples",
    )
    return collect_samples(answered.withColumn("response", clean(F.col("response"))), key)


def predicted_rows(
    df: DataFrame,
    predict: Callable[[list[str]], list[str]],
    text: str = "biased",
    size: int = PREDICT_BATCH,
) -> DataFrame:
    """Add ``predicted``: texts go to ``predict`` in lists of ``size``; to be written before it is read."""
    schema = T.StructType([*df.schema.fields, T.StructField("predicted", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held(batches, size * max(1, HELD_ROWS // size)):
            texts = batch.column(text).to_pylist()
            found: list[str] = []
            for at in range(0, len(texts), size):
                found += predict(texts[at : at + size])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def batch_predict(
    df: DataFrame,
    predict: Callable[[list[str]], list[str]],
    text: str = "biased",
    size: int = PREDICT_BATCH,
) -> DataFrame:
    """``predicted_rows``, written once."""
    return stage(predicted_rows(df, predict, text, size), "predictions")
