"""Token arrays as small numbers, with one dictionary per block of rows.

Texts are read and tokenised once. A task cuts its rows into blocks of a bounded
number of tokens, and writes each block as one record: the rows, with a number in
place of each token, and the dictionary, the block's distinct tokens and how
often each part of the rows holds them. Only dictionaries are counted and looked
up; the ids come back as one array per block.

The table is written in buckets of the block's number, which a task does without
an exchange, and the ids are dealt to the same buckets: the rows, and with them
every occurrence of a token, stay where they were written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tandem.session import new_path

# A block's number holds its task's partition above this bit.
_BLOCK_BITS = 24
#: Tokens of a block; a single longer row is a block of its own.
BLOCK_TOKENS = 1 << 20


def _cut(batch: pa.RecordBatch, keep: int, tokens: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``tokens`` tokens, or a single longer row."""
    sizes = sum(pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64) for a in batch.columns[keep:])
    part = (np.cumsum(sizes) - sizes) // tokens
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
        yield batch.slice(start, end - start)


def _listed(values: pa.Array) -> pa.Array:
    """All values as the one array of a single record."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _numbered(keep: int, parts: int, schema: pa.Schema, tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << _BLOCK_BITS
        row = schema.field("_rows").type.value_type
        for given in batches:
            for batch in _cut(given, keep, tokens):
                lists = batch.columns[keep:]
                values = pa.chunked_array([a.flatten() for a in lists], pa.string()).combine_chunks().dictionary_encode()
                codes = pc.fill_null(values.indices, -1)
                rows, times, at = [], [], 0
                for own in lists:
                    sizes = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
                    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
                    mine = codes.slice(at, int(ends[-1]))
                    at += int(ends[-1])
                    rows.append(pa.ListArray.from_arrays(pa.array(ends), mine))
                    found = mine.to_numpy(zero_copy_only=False)
                    times.append(_listed(pa.array(np.bincount(found[found >= 0], minlength=len(values.dictionary)), pa.int64())))
                whole = pa.StructArray.from_arrays([*batch.columns[:keep], *rows], names=[row.field(i).name for i in range(row.num_fields)])
                made = [pa.array([block], pa.int64()), _listed(whole), _listed(values.dictionary), *times]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, schema, strict=True)], schema.names)
                block += 1

    return run


@dataclass(frozen=True)
class TokenBlocks:
    """One record per block: its rows (``keep`` columns, an array of numbers per part) and its dictionary."""

    table: DataFrame
    keep: tuple[str, ...]
    parts: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame, keep: Sequence[str], parts: Mapping[str, Column], block_tokens: int = BLOCK_TOKENS) -> TokenBlocks:
        """Tokenise ``parts`` (token arrays; null counts as empty), carrying the columns of ``keep``."""
        spark = df.sparkSession
        kept = [T.StructField(c, df.schema[c].dataType) for c in keep]
        numbers = [T.StructField(f"_part_{i}", T.ArrayType(T.IntegerType())) for i in range(len(parts))]
        schema = T.StructType(
            [
                T.StructField("_block", T.LongType()),
                T.StructField("_rows", T.ArrayType(T.StructType([*kept, *numbers]))),
                T.StructField("_words", T.ArrayType(T.StringType())),
                *(T.StructField(f"_times_{i}", T.ArrayType(T.LongType())) for i in range(len(parts))),
            ]
        )
        read = df.select(*keep, *(parts[p].alias(f"_tokens_{i}") for i, p in enumerate(parts)))
        blocks = read.mapInArrow(_numbered(len(kept), len(parts), to_arrow_schema(schema), block_tokens), schema)
        name = f"token_blocks_{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        blocks.write.format("parquet").bucketBy(buckets, "_block").option("path", new_path(spark, name)).saveAsTable(name)
        return cls(spark.table(name), tuple(keep), tuple(parts))

    def rows(self) -> int:
        """The number of rows, from the blocks' sizes alone."""
        return self.table.agg(F.sum(F.size("_rows"))).first()[0] or 0

    def words(self) -> DataFrame:
        """(_block, code, token, and by part its number of occurrences)."""
        times = [f"_times_{i}" for i in range(len(self.parts))]
        listed = self.table.select("_block", F.posexplode(F.arrays_zip("_words", *times)).alias("code", "e"))
        return listed.select("_block", "code", F.col("e._words").alias("token"), *(F.col(f"e.{t}").alias(p) for t, p in zip(times, self.parts, strict=True)))

    def counts(self, weights: Mapping[str, int] | None = None) -> DataFrame:
        """(token, n): occurrences in all rows, each part's weighed; tokens of weight 0 alone are left out."""
        weights = weights or dict.fromkeys(self.parts, 1)
        weighed = sum((F.col(p) * weights[p] for p in weights), F.lit(0).cast("bigint"))
        return self.words().groupBy("token").agg(F.sum(weighed).alias("n")).where("n > 0")

    def encoded(self, ids: DataFrame, unknown: int) -> DataFrame:
        """The rows with the ids (token, token_id) of their tokens, ``unknown`` where there is none."""
        words = self.table.select("_block", F.posexplode("_words").alias("code", "token"))
        found = words.join(ids.select("token", "token_id"), "token", "left")
        entry = F.struct("code", F.coalesce("token_id", F.lit(unknown)).cast("int").alias("id"))
        looked_up = found.groupBy("_block").agg(F.sort_array(F.collect_list(entry)).getField("id").alias("_ids"))  # a block's tokens
        blocks = self.table.select("_block", "_rows").join(looked_up.hint("shuffle_hash"), "_block", "left")

        def row(r: Column) -> Column:
            numbers = (
                F.transform(r[f"_part_{i}"], lambda c: F.coalesce(F.get("_ids", c), F.lit(unknown))).alias(p) for i, p in enumerate(self.parts)
            )
            return F.struct(*(r[c].alias(c) for c in self.keep), *numbers)

        return blocks.select(F.inline(F.transform("_rows", row)))
