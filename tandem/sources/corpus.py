"""Parallel corpus scan: tab-separated rows to cleaned text pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names of the corpus, the two that are used, and the texts
# that count as missing.
CORPUS_COLUMNS = (
    "id",
    "src_tok",
    "tgt_tok",
    "src_raw",
    "tgt_raw",
    "src_POS_tags",
    "tgt_parse_tags",
)
SOURCE_COLUMN, TARGET_COLUMN = "src_raw", "tgt_raw"
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

_BAD = "_corrupt_record"


def scan_corpus(spark: SparkSession, path: str, quote: str = "") -> DataFrame:
    """All-string rows of a headerless TSV; rows with too many fields are left out.

    Short rows stay, with nulls. A missing path raises, as for any Spark scan.
    No quote sign is recognised unless one is given.
    """
    schema = ", ".join(f"`{name}` string" for name in (*CORPUS_COLUMNS, _BAD))
    rows = (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("quote", quote)
        .option("escape", quote)
        .option("columnNameOfCorruptRecord", _BAD)
        .option("columnPruning", "false")  # field counts need the whole line
        .csv(path)
    )
    return rows.filter(~_too_long(quote)).drop(_BAD)


def scan_over_long(spark: SparkSession, path: str, quote: str = "") -> DataFrame:
    """The lines that ``scan_corpus`` leaves out, to be reported."""
    lines = spark.read.text(path).select(F.col("value").alias(_BAD))
    return lines.filter(_too_long(quote)).select(F.col(_BAD).alias("line"))


def _too_long(quote: str) -> Column:
    line = F.col(_BAD)
    if quote:
        line = F.regexp_replace(line, f"{quote}[^{quote}]*{quote}", "")
    fields = F.size(F.split(line, "\t"))
    return F.coalesce(fields > len(CORPUS_COLUMNS), F.lit(False))


def missing_to_null(text: Column) -> Column:
    """Null for every text that stands for a missing value."""
    return F.when(~text.isin(*NA_TOKENS), text)


def normalise_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({name: missing_to_null(F.col(name)) for name in columns})


def project_pairs(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The two text columns as ``biased`` and ``neutral``, and any key columns."""
    return df.select(
        *keep, F.col(SOURCE_COLUMN).alias("biased"), F.col(TARGET_COLUMN).alias("neutral")
    )


def drop_null_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.na.drop(subset=["biased", "neutral"])


def load_pairs(spark: SparkSession, path: str, quote: str = "") -> DataFrame:
    """Scan, normalise, prune and clean in one chain."""
    rows = normalise_missing(scan_corpus(spark, path, quote), [SOURCE_COLUMN, TARGET_COLUMN])
    return drop_null_pairs(project_pairs(rows, keep=["id"]))
