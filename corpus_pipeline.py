"""A corpus pipeline: five stages, each an operator of tandem.llm over all that the one before kept.

Every stage takes (spark, docs, sf_dir). All but the last give rows of ``docs`` with
their own columns; each result is written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import exact, minhash, mixing, packing, toxicity
from tandem.llm.queries import table, vocabulary
from tandem.session import stage


#: Rows that go to a Python worker at once: texts are long, and a batch lies in the executor and in its worker.
BATCH_ROWS = 1000
#: Bytes of text that packing encodes at once, and words it remembers: a worker lives on beside the JVM that the earlier stages filled.
PIECE, KNOWN_WORDS = 1 << 19, 50_000


def small_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH_ROWS`` rows from here on, whatever the session had."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by a classifier learnt from the labels that are not held out."""
    small_batches(spark)
    score = toxicity.scorer(spark, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, but for white space, the row with the smallest doc_id."""
    return exact.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked near-copies the row with the smallest doc_id."""
    small_batches(spark)
    return minhash.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs, stage(mixing.mix(docs), "mix"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    small_batches(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), piece=PIECE, known_words=KNOWN_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: A learnt classifier and a tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the pieces of the last one."""
    docs = table(spark, sf_dir)
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
