"""Harmonic packing of token sequences, each worker on its own.

Lengths fall into classes by the reciprocal of the capacity: class j holds
pieces of which j fit one sequence, so a sequence of class j is full after j
pieces, whatever they are, and workers need not speak to each other. A document
is cut into whole sequences and a rest; a rest that would leave its class's
sequences too empty is cut again, at the next lower reciprocal exactly. What no
worker could complete is cut anew as one stream per group of workers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.token_ids import TABLE, word_encoder
from tandem.llm.words import pieces
from tandem.session import stage

CAPACITY = 4096
#: Rests of at most this part of the capacity, and classes that leave at most this part unused, are not cut.
SMALL, WASTE = 1 / 32, 0.02
#: Bytes of text encoded at once.
_PIECE = 4 << 20
#: Workers whose incomplete sequences are cut anew together.
WORKERS_A_GROUP = 8

_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
    " sequence_id long, offset long, ids binary"
)
_LEFT = _SCHEMA + ", _worker int, _at long"


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, length, class) of the pieces of a document."""
    whole = length // capacity
    out = [(i * capacity, capacity, 1) for i in range(whole)]
    start, rest = whole * capacity, length % capacity
    while rest:
        fits = capacity // rest
        if rest <= capacity * SMALL or capacity - fits * rest <= capacity * WASTE:
            out.append((start, rest, fits))
            break
        own = capacity // (fits + 1)
        out.append((start, own, fits + 1))
        start, rest = start + own, rest - own
    return out


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _filled(capacity: int, path: str, end_id: int, keep_ids: bool, piece: int, known_words: int | None):
    schema = pa.schema(
        [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + [("ids", pa.binary()), ("_worker", pa.int32()), ("_at", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        worker = TaskContext.get().partitionId()
        open_: dict[int, list] = {}
        sequences = order = 0

        def table(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

        for batch in pieces(batches, most=piece, table=TABLE):
            rows: list = []
            ids, sizes = encoder.encode_all(batch.column(1), end_id, known_words)
            data, first = memoryview(ids.astype("<u4").tobytes()), 0
            for doc_id, total in zip(batch.column(0).to_pylist(), sizes.tolist(), strict=True):
                for start, length, fits in cuts(total, capacity):
                    own = bytes(data[4 * (first + start) : 4 * (first + start + length)])
                    order += 1
                    waiting = open_.setdefault(fits, [])
                    waiting.append((doc_id, start, length, own, total, order))
                    if len(waiting) == fits:
                        offset = 0
                        for d, s, n, b, total, _ in waiting:
                            rows.append(
                                (d, s, n, zlib.crc32(b), total, worker << 40 | sequences, offset,
                                 b if keep_ids else None, None, None)
                            )
                            offset += n
                        sequences += 1
                        del open_[fits]
                first += total
            if rows:
                yield table(rows)
        left = sorted((p for waiting in open_.values() for p in waiting), key=lambda p: p[5])
        for at in range(0, len(left), 2000):
            yield table(
                [(d, s, n, None, total, None, None, b, worker, at_) for d, s, n, b, total, at_ in left[at : at + 2000]]
            )

    return run


def _streamed(capacity: int, keep_ids: bool):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows, sequence, offset = [], 0, 0
        base = 1 << 62 | int(key[0]) << 32
        group = group.sort_values(["_worker", "_at"])
        for d, s, total, data in zip(group.doc_id, group.start, group.doc_tokens, group.ids, strict=True):
            ids, at = np.frombuffer(data, "<u4"), 0
            while at < len(ids):
                own = ids[at : at + capacity - offset]
                rows.append(
                    (d, s + at, len(own), crc(own), total, base | sequence, offset, own.tobytes() if keep_ids else None)
                )
                at, offset = at + len(own), offset + len(own)
                if offset == capacity:
                    sequence, offset = sequence + 1, 0
        out = pd.DataFrame(
            rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        )
        return out.astype({"doc_id": "Int64"})

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = 2,
    keep_ids: bool = False,
    piece: int = _PIECE,
    known_words: int | None = None,
) -> DataFrame:
    """Pack the token ids of whole texts into sequences of at most ``capacity`` ids.

    Reads ``doc_id`` and ``text``, ignores other columns. Each text's ids end
    with ``end_id``; a null or empty text is that id alone. Returns one row per
    piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    with ``keep_ids`` the little-endian 32-bit ids. Each id lies in one piece.
    Repeated rows are packed each for itself; a null doc_id stays null. An empty
    table gives an empty result. A text file of the vocabulary is named by path;
    a worker encodes ``piece`` bytes of text at once and remembers the ids of about twice ``known_words`` words
    (or ``words.CACHE_WORDS``), which bound its memory alone.
    """
    filled = stage(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
            _filled(capacity, tokenizer, end_id, keep_ids, piece, known_words), _LEFT
        ),
        "packed",
    )
    columns = [c for c in filled.columns if not c.startswith("_") and (keep_ids or c != "ids")]
    streamed = (
        filled.where("_worker IS NOT NULL")
        .groupBy(F.floor(F.col("_worker") / WORKERS_A_GROUP).alias("_group"))
        .applyInPandas(_streamed(capacity, keep_ids), _SCHEMA)
    )
    return filled.where("_worker IS NULL").select(*columns).unionByName(streamed.select(*columns))
