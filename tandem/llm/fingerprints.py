"""Threshold-scaled fingerprints, in DataFrame functions only.

A fingerprint keeps every word-shingle hash below a fixed fraction of the hash
range, and the least hash, so that no text with words has an empty one. Two
fingerprints merge by union, and as both keep the same part of their shingles,
the part of the smaller found in the larger estimates containment, however
unequal the documents are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.tables import bounded_join
from tandem.llm.words import text_or_empty, word_array
from tandem.operators.ordinals import with_ordinals
from tandem.session import stage

WORDS = 5
#: Hashes, as 16 hexadecimal digits, below this are kept: one in eight.
BELOW = "2000000000000000"
#: Columns that name a document within the joins.
_KEY = ["_id", "_no_id", "_hash"]


def _id_key(doc_id: str, name: str, missing: str) -> tuple[Column, Column]:
    """An id as two columns without nulls, which plain equality compares."""
    return F.coalesce(F.col(doc_id), F.lit(0).cast("bigint")).alias(name), F.col(doc_id).isNull().alias(missing)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """The hash of each run of ``words`` words; of all words, if there are fewer."""

    def hashed(own: Column) -> Column:
        return F.substring(F.md5(F.array_join(own, " ").cast("binary")), 1, 16)

    def of(own: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(1), F.size(own) - (words - 1)), lambda i: hashed(F.slice(own, i, words))
        )
        return (
            F.when(F.size(own) >= words, runs)
            .when(F.size(own) > 0, F.array(hashed(own)))
            .otherwise(F.array().cast("array<string>"))
        )

    # a one-element transform names the words, which are then cut only once
    return F.element_at(F.transform(F.array(word_array(text)), of), 1)


def fingerprint(text: Column, below: str = BELOW) -> Column:
    """The sorted distinct kept hashes of a text."""

    def of(hashes: Column) -> Column:
        return F.array_sort(
            F.array_distinct(
                F.concat(
                    F.filter(hashes, lambda h: h < below),
                    F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull()),
                )
            )
        )

    return F.element_at(F.transform(F.array(shingle_hashes(text)), of), 1)


def merged(a: Column, b: Column) -> Column:
    """The fingerprint of two documents together."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """The estimated part of the smaller document found in the other; two empty ones are alike."""
    least = F.least(F.size(a), F.size(b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when(least == 0, 0.0)
        .otherwise(F.size(F.array_intersect(a, b)) / least)
    )


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, _hash, next_id, next_hash, next_share): each document's successor by doc_id.

    Only ids, hashes and lengths are put in order. ``next_share`` is how many
    signs of the successor the document takes, a quarter of its own length.
    """
    slim = stage(
        docs.select("doc_id", F.xxhash64("text").alias("_hash"), F.length("text").alias("_n")).distinct(),
        "fingerprint-ids",
    )
    placed = stage(with_ordinals(slim, [F.col("doc_id").asc_nulls_first(), "_hash"], "_at"), "fingerprint-order")
    total = placed.count()
    follows = placed.select(
        F.pmod(F.col("_at") - 1, F.lit(max(total, 1))).alias("_at"),
        F.col("doc_id").alias("next_id"),
        F.col("_hash").alias("next_hash"),
    )
    return stage(
        placed.join(follows, "_at").select(
            "doc_id", "_hash", "next_id", "next_hash", F.floor(F.col("_n") / 4).cast("int").alias("next_share")
        ),
        "fingerprint-next",
    )


def fingerprints(docs: DataFrame, below: str = BELOW) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they are to their neighbours.

    Reads ``doc_id`` and ``text`` (null: empty), ignores other columns. The edited
    text has its last quarter of code points replaced by the first as many of the
    next document, in order of doc_id (null ids first, rows of one id by a hash
    of the text); after the last comes the first. Returns per row doc_id, n_chars, edited (text),
    fingerprint, edited_fingerprint, next_fingerprint (arrays). Rows equal in id
    and text count as one document and keep their number. An empty table gives
    an empty result. A text moves once, its successor's share and fingerprint
    too, whether or not the ordered ids are few enough to broadcast.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))
    follows = with_next(texts)
    # the id lives in its key alone, so that both joins deal the texts alike and share one exchange
    keyed = texts.select(*_id_key("doc_id", "_id", "_no_id"), F.xxhash64("text").alias("_hash"), "text")
    ahead = follows.select(
        *_id_key("next_id", "_id", "_no_id"),
        F.col("next_hash").alias("_hash"),
        *_id_key("doc_id", "_of", "_of_no_id"),
        F.col("_hash").alias("_of_hash"),
        "next_share",
    )
    shares = (
        bounded_join(keyed, ahead, _KEY, "inner")
        .select(
            F.col("_of").alias("_id"),
            F.col("_of_no_id").alias("_no_id"),
            F.col("_of_hash").alias("_hash"),
            F.substring(F.col("text"), F.lit(1), F.col("next_share")).alias("_share"),
            fingerprint(F.col("text"), below).alias("next_fingerprint"),
        )
        .dropDuplicates(_KEY)
    )
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 4).cast("int")), F.col("_share"))
    doc_id = F.when(~F.col("_no_id"), F.col("_id")).alias("doc_id")
    return (
        keyed.join(shares, _KEY)
        .select(doc_id, n.cast("bigint").alias("n_chars"), edited.alias("edited"), "text", "next_fingerprint")
        .select(
            "doc_id",
            "n_chars",
            "edited",
            fingerprint(F.col("text"), below).alias("fingerprint"),
            fingerprint(F.col("edited"), below).alias("edited_fingerprint"),
            "next_fingerprint",
        )
    )
