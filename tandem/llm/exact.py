"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut after the first sentence end past ``_LEAST`` signs (and
at ``_MOST`` signs where there is none), so the cuts depend on content alone. The
distinct chunks are gathered once, content and all: a chunk's identifier is its
64-bit hash, made certain by that table, in which two contents under one hash get
numbers of their own. A document is then the ordered list of its identifiers, and
only these short lists are grouped; whole texts never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.tables import bounded_join, unused
from tandem.llm.words import SPACE_RUN, text_or_empty
from tandem.session import stage

_LEAST, _MOST = 256, 2048
_CHUNK = rf"(?s).{{{_LEAST},{_MOST}}}?[.!?] |.{{1,{_MOST}}}"


def normalised(text: Column | str) -> Column:
    """A text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), SPACE_RUN, " ")


def chunks(text: Column) -> Column:
    """The content-defined chunks of a normalised text, in order."""
    return F.regexp_extract_all(text, F.lit(_CHUNK), F.lit(0))


def chunk_hash(chunk: Column, bits: int = 64) -> Column:
    hashed = F.xxhash64(chunk)
    return hashed if bits == 64 else hashed.bitwiseAND(F.lit((1 << bits) - 1))


def chunk_variants(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(_hash, _chunk, _variant): chunks that share a hash with another content, numbered from 1.

    Each distinct chunk moves once from a map task. With 64 bits the result is
    nearly always empty; it stays correct when it is not.
    """
    found = (
        docs.select(F.explode(chunks(normalised("text"))).alias("_chunk"))
        .select(chunk_hash(F.col("_chunk"), bits).alias("_hash"), "_chunk")
        .distinct()
    )
    shared = found.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return found.join(shared.select("_hash"), "_hash").withColumn(
        "_variant", F.row_number().over(Window.partitionBy("_hash").orderBy("_chunk"))
    )


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, text_sha256, recipe): each document's ordered, verified chunk identifiers."""
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised("text").alias("_text"))
    listed = stage(
        text.select(
            "doc_id",
            F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"),
            F.transform(chunks(F.col("_text")), lambda c: chunk_hash(c, bits)).alias("recipe"),
        ),
        "recipes",
    )
    variants = stage(chunk_variants(docs.select("text"), bits), "chunk-variants")
    if variants.isEmpty():
        return listed
    clashing = (
        text.select(
            F.col("doc_id").alias("_id"),
            F.sha2(F.col("_text").cast("binary"), 256).alias("_sha"),
            F.posexplode(chunks(F.col("_text"))).alias("_at", "_chunk"),
        )
        .distinct()
        .withColumn("_hash", chunk_hash(F.col("_chunk"), bits))
        .join(variants, ["_hash", "_chunk"])
        .groupBy("_id", "_sha")
        .agg(F.sort_array(F.collect_list(F.struct("_at", "_variant"))).alias("_variants"))
    )
    numbers = F.flatten(
        F.transform(
            F.coalesce("_variants", F.expr("cast(array() as array<struct<_at: int, _variant: int>>)")),
            lambda v: F.array(v["_at"].cast("bigint"), v["_variant"].cast("bigint")),
        )
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha"))
    return listed.join(clashing, same, "left").select(
        "doc_id", "text_sha256", F.concat("recipe", numbers).alias("recipe")
    )


def exact_duplicates(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Groups of documents whose texts are equal but for runs of white space.

    Reads ``doc_id`` and ``text`` and ignores other columns. Returns, per row,
    doc_id, keep_id (smallest doc_id with that text), group_size, kept and
    text_sha256. Null and empty texts are one text. Rows that repeat both id and
    text stay or go together; a row without an id never gives its group a
    keep_id, and is kept only if no row of the group has one. An empty table
    gives an empty result. ``bits`` narrows the chunk hash, for tests.
    """
    listed = recipes(docs, bits)
    groups = listed.groupBy("recipe").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return listed.join(groups, "recipe").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their own columns; of rows that repeat id and text, one."""
    found = stage(exact_duplicates(docs), "exact")
    key = ["doc_id", "text_sha256"]
    mine = unused(docs, "_gone_id", "_gone_sha")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(mine[0])) & (
        F.sha2(normalised("text").cast("binary"), 256) == F.col(mine[1])
    )

    def names(rows: DataFrame) -> DataFrame:
        return rows.select(*key).distinct().toDF(*mine)

    left = bounded_join(docs, names(found.where("NOT kept")), same, "left_anti")
    twice = stage(names(found.where("kept").groupBy(*key).count().where("count > 1")), "exact-twice")
    if twice.isEmpty():
        return left
    once = left.join(twice, same).dropDuplicates(mine).select(*docs.columns)
    return left.join(twice, same, "left_anti").unionByName(once)
