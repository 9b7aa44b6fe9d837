"""Words, as runs free of the six ASCII white-space signs, for SQL and for Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Entries a worker's table of word ids, or of word hashes, may hold before it starts afresh.
CACHE_WORDS, CACHE_HASHES = 500_000, 200_000


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text as an array; none for an empty or null one."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


#: What empties the table that a worker keeps from task to task, by the table's name.
KEPT: dict[str, Callable[[], None]] = {}


def give_back(table: str | None = None) -> None:
    """Empty the tables of other operators and return free memory to the system: a worker lives on and runs tasks of other stages."""
    for name, empty in KEPT.items():
        if name != table:
            empty()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, table: str | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that long texts do not pile up; of the tables in ``KEPT`` only ``table`` stays."""
    give_back(table)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back(table)


class WordHashes(dict):
    """64-bit hash of a word, remembered up to ``CACHE_HASHES`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_HASHES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _signs(space: bytes, lower: bool) -> np.ndarray:
    """For each byte: itself, in small letters if wanted, or a space where it ends a word."""
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    out[list(space)] = 32
    return out


#: Words between white space, as they are and in small letters, and runs of letters (ASCII in small letters, or beyond ASCII).
PLAIN = _signs(bytes([32, *range(9, 14)]), False)
LOWER = _signs(bytes([32, *range(9, 14)]), True)
LETTERS = _signs(bytes([*range(65), *range(91, 97), *range(123, 128)]), True)


def cut(texts: pa.Array, signs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(every word of the texts, one after the other, and each text's number of words)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = signs[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    ends = ends - ends[0]
    inside = data != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = ends[:-1][ends[:-1] < len(data)]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    data = data[inside]
    places = np.empty(len(starts) + 1, np.int32)
    places[:-1] = np.cumsum(inside, dtype=np.int32)[starts] - 1
    places[-1] = len(data)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data)])
    return words, np.diff(np.searchsorted(starts, ends))


def pieces(
    batches: Iterator[pa.RecordBatch], name: str = "text", most: int = 4 << 20, table: str | None = None
) -> Iterator[pa.RecordBatch]:
    """Batches whose texts hold at most ``most`` bytes, or a single longer text; of the tables in ``KEPT`` only ``table`` stays."""
    give_back(table)
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False)
        before = np.cumsum(sizes, dtype=np.int64) - sizes
        part = before // most
        at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
        for start, end in zip(at, np.append(at[1:], batch.num_rows), strict=True):
            yield batch.slice(int(start), int(end - start))
    give_back(table)
