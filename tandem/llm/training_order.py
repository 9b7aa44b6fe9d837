"""Token shards in training order: a keyed permutation gives every sequence its slot.

Each worker cuts its documents' ids into sequences of one length. Their numbers,
dense over all workers, go through a Feistel network on the next even power of
two; a number that falls outside the range is put through again until it is
inside. Slots are spread over shards by range, and a shard is a file of
sequences of a fixed stride, so that slot s lies at a known byte of a known file:
a reader needs one seek to resume anywhere.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.llm.token_ids import TABLE, word_encoder
from tandem.llm.words import pieces
from tandem.session import new_path, stage

LENGTH, END_ID = 2048, 2
#: Sequences of a shard: 16 MiB of 16-bit ids.
SHARD = 4096
#: Bytes of text encoded at once.
_PIECE = 4 << 20
KEY, ROUNDS = 20240607, 4


def _round_hash(half: np.ndarray, key: int, turn: int, mask: np.uint64) -> np.ndarray:
    x = half + np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xC2B2AE3D27D4EB4F + 1) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & mask


def slots(numbers: np.ndarray, total: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The place of each number of 0 .. total - 1 under the keyed permutation."""
    bits = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> shift, out[walking] & mask
        for turn in range(rounds):
            left, right = right, left ^ _round_hash(right, key, turn, mask)
        out[walking] = left << shift | right
        walking = walking[out[walking] >= total]
    return out.astype(np.int64)


def _cut(path: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, worker, squeeze = word_encoder(path), TaskContext.get().partitionId(), zstandard.ZstdCompressor(3)
        if max(encoder.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        held, first, at = np.empty(0, "<u2"), None, 0

        def table(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["_worker", "_at", "first_doc_id", "n_tokens", "ids_crc32", "_ids"],
            )

        def row(ids: np.ndarray) -> tuple:
            full = np.concatenate((ids, np.full(length - len(ids), end_id, "<u2"))).tobytes()
            return (worker, at, first, len(ids), zlib.crc32(full), squeeze.compress(full))

        for batch in pieces(batches, most=_PIECE, table=TABLE):
            ids, sizes = encoder.encode_all(batch.column(1), end_id)
            docs = [first, *batch.column(0).to_pylist()]
            stops = np.cumsum(np.append(len(held), sizes))
            joined = np.concatenate((held, ids.astype("<u2")))
            rows = []
            for k in range(len(joined) // length):
                first = docs[int(np.searchsorted(stops, k * length, "right"))]
                rows.append(row(joined[k * length : (k + 1) * length]))
                at += 1
            held = joined[len(rows) * length :]
            if len(held):
                first = docs[int(np.searchsorted(stops, len(rows) * length, "right"))]
            if rows:
                yield table(rows)
        if len(held):
            yield table([row(held)])

    return run


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def shard_name(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def _write(folder: str, length: int, shard_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        expand = zstandard.ZstdDecompressor()
        out, now, draft = None, None, None

        def close() -> None:
            if out is not None:
                out.close()
                files.move(draft, shard_name(root, now))  # a task that runs twice writes the same file

        for batch in batches:
            slot, payload = batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for s, ids in zip(slot, payload, strict=True):
                if s // shard_size != now:
                    close()
                    now = s // shard_size
                    draft = f"{shard_name(root, now)}.{uuid.uuid4().hex}"
                    out = files.open_output_stream(draft)
                out.write(expand.decompress(ids, max_output_size=2 * length))
            yield batch.select(list(range(batch.num_columns - 1)))
        close()

    return run


def materialise(
    docs: DataFrame,
    tokenizer: str,
    folder: str | None = None,
    length: int = LENGTH,
    shard_size: int = SHARD,
    key: int = KEY,
    end_id: int = END_ID,
) -> tuple[DataFrame, str]:
    """Write every document's ids as shards in training order; returns (manifest, folder).

    Reads ``doc_id`` and ``text``, ignores other columns. A text's ids end with
    ``end_id``; null and empty texts are that id alone. Ids of a vocabulary under
    65,536 entries are kept as 16-bit little-endian numbers, and a larger one is refused; the last sequence of a worker
    is filled with ``end_id``. The manifest has one row per sequence: slot,
    shard, byte_offset, first_doc_id, n_tokens, ids_crc32. Slots run from 0
    without a gap. Repeated rows are written each; a null id stays null; an empty table
    gives an empty manifest and no file. ``folder`` must be one all executors reach.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "shards")
    files, root = _open(folder)
    files.create_dir(root, recursive=True)
    cut = stage(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
            _cut(tokenizer, length, end_id),
            "_worker int, _at long, first_doc_id long, n_tokens long, ids_crc32 long, _ids binary",
        ),
        "sequences",
    )
    # one row per worker
    sizes = cut.groupBy("_worker").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_worker").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_worker", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    total = cut.count()

    @F.pandas_udf("long")
    def slot(numbers: pd.Series) -> pd.Series:
        return pd.Series(slots(numbers.to_numpy(), total, key))

    placed = (
        cut.join(F.broadcast(offsets), "_worker")
        .withColumn("slot", slot(F.col("_before") + F.col("_at")))
        .withColumn("shard", F.floor(F.col("slot") / shard_size))
        .withColumn("byte_offset", (F.col("slot") % shard_size) * (2 * length))
        .select("slot", "shard", "byte_offset", "first_doc_id", "n_tokens", "ids_crc32", "_ids")
    )
    shards = max(1, -(-total // shard_size))
    manifest = (
        placed.repartitionByRange(shards, "shard")
        .sortWithinPartitions("slot")
        .mapInArrow(
            _write(folder, length, shard_size),
            "slot long, shard long, byte_offset long, first_doc_id long, n_tokens long, ids_crc32 long",
        )
    )
    return stage(manifest, "manifest"), folder


def read_slots(folder: str, start: int, count: int, length: int = LENGTH, shard_size: int = SHARD) -> Iterator[np.ndarray]:
    """The sequences of slots start, start + 1, ... in order, as a trainer that resumes reads them."""
    files, root = _open(folder)
    slot, stop = start, start + count
    while slot < stop:
        shard = slot // shard_size
        with files.open_input_file(shard_name(root, shard)) as source:
            source.seek(slot % shard_size * 2 * length)
            while slot < stop and slot // shard_size == shard:
                yield np.frombuffer(source.read(2 * length), "<u2")
                slot += 1


def shard_folder(spark: SparkSession) -> str:
    """A new folder for shards in the shared folder."""
    return new_path(spark, "shards")
