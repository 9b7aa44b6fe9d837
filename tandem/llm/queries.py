"""The registered queries of this package, each one operator over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import divergence, exact, fingerprints, jaccard_join, licenses, minhash, mixing, packing, repeats, runs, secrets, toxicity, training_order

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def vocabulary(name: str) -> str:
    """A public vocabulary file by its name."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"))

    def listed(spans: str):
        shown = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(shown, ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(kind) for kind in secrets.KINDS[:3]),
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


@query
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir))


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.fingerprints(table(spark, sf_dir))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("fingerprint", "").alias("fingerprint"),
        F.array_join("edited_fingerprint", "").alias("edited_fingerprint"),
        fingerprints.containment(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.containment(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir)).select(
        "doc_id",
        "n_sentences",
        "n_known",
        F.array_join(F.col("sentences").cast("array<string>"), ",").alias("sentences"),
        F.array_join("licenses", ",").alias("licenses"),
    )


@query
def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, _ = training_order.materialise(table(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return manifest


@query
def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir))


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words that are read in a tenth of the texts: from one place on, the first ones there over and over."""
    chance = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if chance % 10 or not n:
        return None
    a = chance // 10 % n
    p = 1 + (n - a) // (3 + chance // 10 % 8)
    return np.append(np.arange(a), a + np.arange(n - a) % p)


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir), reorder=looped)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "strongest.start",
        "strongest.length",
        "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir))
