"""Sharded minimal perfect hashes whose keys are kept, so that foreign words are told apart.

A shard places each key, level by level, at a bit of a small field: keys alone at
their bit stay, the others go on to the next level's field. A key's slot is the
number of set bits before its own, so n keys have the slots 0 to n - 1. Fields
hold about four bits per key; the keys lie beside them in slot order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_STEP = 0x9E3779B97F4A7C15
_ONE = np.uint64(1)


def key_hashes(keys: Sequence[bytes], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k, seed) for k in keys), np.uint64, len(keys))


def _spots(hashes: np.ndarray, level: int, sizes) -> np.ndarray:
    """The bit of each hash in its field of a level."""
    x = hashes + np.uint64(_STEP * (level + 1) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.asarray(sizes, np.uint64)).astype(np.int64)


def build(keys: Sequence[bytes], seed: int) -> tuple[int, list[int], bytes, np.ndarray]:
    """(turn, bits of each level, the fields, the slot order of the keys) of distinct keys.

    Keys whose hashes collide are hashed anew with the next seed; ``turn`` counts that.
    """
    turn, hashes = 0, key_hashes(keys, seed)
    while len(np.unique(hashes)) < len(hashes):
        turn += 1
        hashes = key_hashes(keys, seed + turn & (1 << 64) - 1)
    sizes, fields, place = [], [], np.empty(len(keys), np.int64)
    open_, before = np.arange(len(keys)), 0
    while len(open_):
        size = -(-2 * len(open_) // 64) * 64
        at = _spots(hashes[open_], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        done = alone[at]
        place[open_[done]] = before + at[done]
        sizes.append(size)
        fields.append(alone)
        open_, before = open_[~done], before + size
    bits = np.packbits(np.concatenate(fields), bitorder="little").tobytes() if fields else b""
    return turn, sizes, bits, np.argsort(place)


@dataclass
class Shard:
    """One built shard; ``ends`` are the ends of the keys, one after the other, in slot order."""

    group: str
    number: int
    seed: int
    turn: int
    sizes: list[int]
    bits: bytes
    keys: bytes
    ends: bytes


class ShardedHash:
    """Several shards as one table: slots are numbered through all of them, in the order given."""

    def __init__(self, shards: Sequence[Shard]):
        self.row = {(s.group, s.number): i for i, s in enumerate(shards)}
        self.seeds, self.turns = [s.seed for s in shards], np.array([s.turn for s in shards], np.int64)
        levels = max((len(s.sizes) for s in shards), default=0)
        self.sizes = np.zeros((len(shards), levels), np.int64)
        self.starts = np.zeros((len(shards), levels), np.int64)
        at = 0
        for i, s in enumerate(shards):
            for level, size in enumerate(s.sizes):
                self.sizes[i, level], self.starts[i, level] = size, at
                at += size
        self.words = np.frombuffer(b"".join(s.bits for s in shards), np.uint64)
        counts = np.bitwise_count(self.words)
        self.before = np.cumsum(counts, dtype=np.int64) - counts
        self.firsts = np.cumsum([0] + [len(s.ends) // 4 for s in shards])
        ends = [np.zeros(1, np.int64)]
        for s in shards:
            ends.append(np.frombuffer(s.ends, np.int32).astype(np.int64) + ends[-1][-1])
        self.keys = pa.Array.from_buffers(
            pa.large_binary(),
            int(self.firsts[-1]),
            [None, pa.py_buffer(np.concatenate(ends)), pa.py_buffer(b"".join(s.keys for s in shards))],
        )

    def slots(self, keys: pa.Array, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key in its shard's row, or -1 where the stored key is another one.

        ``hashes`` were made with the shard's seed; a row of -1 is a shard that is not here.
        """
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.flatnonzero(rows >= 0)
        turned = open_[self.turns[rows[open_]] > 0]
        if len(turned):
            hashes = hashes.copy()
            for i in turned.tolist():
                seed = self.seeds[rows[i]] + int(self.turns[rows[i]]) & (1 << 64) - 1
                hashes[i] = xxhash.xxh64_intdigest(keys[i].as_py(), seed)
        for level in range(self.sizes.shape[1]):
            size = self.sizes[rows[open_], level]
            open_, size = open_[size > 0], size[size > 0]
            at = self.starts[rows[open_], level] + _spots(hashes[open_], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & _ONE == _ONE
            below = np.bitwise_count(word & ((_ONE << bit) - _ONE))
            out[open_[hit]] = (self.before[at >> 6] + below)[hit]
            open_ = open_[~hit]
        found = np.flatnonzero(out >= 0)
        same = pc.equal(self.keys.take(pa.array(out[found])), keys.take(pa.array(found)).cast(pa.large_binary()))
        out[found[~same.to_numpy(zero_copy_only=False)]] = -1
        return out
