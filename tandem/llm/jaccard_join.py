"""Similarity join of word n-gram sets by parity sketches.

A set's parity sketch is a row of blocks of bits; each shingle flips one bit. Two
sets' sketches differ in at most as many bits as the sets differ in shingles, so
of more blocks than that bound some must be equal. Sizes are cut into bands; the
sets of a band, and those of the band below that are large enough for it, are
joined on (block number, block) with a number of blocks that the band's bound
on the symmetric difference fixes.

With ``spare`` more blocks than the bound needs, linked sets have ``spare`` + 1
equal blocks. Blocks with few bits set tell little and would make large buckets;
a set with at most ``spare`` of them need not send these.

Only buckets of two different sets leave the first pass. Each member is compared
with its bucket's least, by short sketches and then by full sets; members that
this leaves apart are compared with each other in blocks, hub by hub.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.components import components
from tandem.llm.minhash import joining, mixed, overlaps
from tandem.llm.tables import bounded_join
from tandem.llm.words import LOWER, cut, pieces
from tandem.session import stage

WORDS, PERCENT = 3, 90
#: 64-bit words of a block, bits a telling block has set at least, and words of the short sketch of a whole set.
_WIDTH, _TELLING, _SHORT = 4, 4, 32
#: Rows of a bin, and bytes of text that may make a block's row, from which the bins are counted.
_BIN_ROWS, _ROW_BYTES = 2_000_000, 20
#: Members of one side of a block of an unsettled hub, with short sketches and with full sets, and shingles of the latter.
_SKETCHES, _SETS, _SET_SHINGLES = 1024, 256, 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def most_apart(sizes, percent: int):
    """The largest symmetric difference of two linked sets, from the sum of their sizes."""
    return sizes * (100 - percent) // (100 + percent)


def bands(largest: int, percent: int) -> np.ndarray:
    """The largest size of each band; a band spans two steps of the least ratio of linked sizes."""
    out = [100 // (100 - percent) + 6 if percent < 100 else 16]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, out[-1] * 10_000 // percent**2))
    return np.array(out, np.int64)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    found, counts = cut(texts, LOWER)
    found = found.dictionary_encode()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found.dictionary.to_pylist()), np.uint64, len(found.dictionary))
    codes = hashed[found.indices.to_numpy(zero_copy_only=False)]
    rolled = np.full(max(0, len(codes) - words + 1), np.uint64(words))
    for k in range(words):
        rolled = rolled * _ODD + codes[k : k + len(rolled)]
    rolled = mixed(rolled)
    out = []
    for end, n in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True):
        if n >= words:
            out.append(np.unique(rolled[end - n : end - words + 1]))
        elif n:
            short = np.full(1, np.uint64(n))
            for code in codes[end - n : end]:
                short = short * _ODD + code
            out.append(mixed(short))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def parities(values: np.ndarray, line: np.ndarray, lines: int, width: int) -> np.ndarray:
    """One row of ``width`` 64-bit words per line, in which each value flips one bit."""
    out = np.zeros(lines * width, np.uint64)
    np.bitwise_xor.at(out, line * width + (values >> np.uint64(6)).astype(np.int64) % width, _ONE << (values & np.uint64(63)))
    return out.reshape(lines, width)


def block_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the set) of the blocks that each set sends."""
    sizes = np.array([len(s) for s in sets], np.int64)
    edges = bands(int(sizes.max(initial=1)) * 2, percent)
    band = np.searchsorted(edges, sizes)
    # sets too small to differ from a linked one have no one to meet
    open_ = np.flatnonzero(most_apart(2 * sizes + 1, percent) > 0)
    above = open_[100 * sizes[open_] >= percent * (edges[band[open_]] + 1)]
    owner, group = np.append(open_, above), np.append(band[open_], band[above] + 1)
    bound = most_apart(2 * edges[group], percent)
    spare = bound // 8
    blocks = bound + 1 + spare
    if not len(owner):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    values = np.concatenate(sets)
    starts = np.cumsum(sizes) - sizes
    n = sizes[owner]
    values = values[np.repeat(starts[owner] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    first = np.cumsum(blocks) - blocks
    line = np.repeat(first, n) + ((values >> np.uint64(32)) * np.repeat(blocks, n).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    sketch = parities(values, line, int(blocks.sum()), _WIDTH)
    visit = np.repeat(np.arange(len(owner)), blocks)
    vague = np.bitwise_count(sketch).sum(1) < _TELLING
    sent = ~vague | (np.bincount(visit, vague, len(owner)) > spare)[visit]
    key = mixed((group[visit] << 32 | np.arange(len(visit)) - first[visit]).astype(np.uint64) + _ODD)
    for k in range(_WIDTH):
        key = mixed(key * _ODD + sketch[:, k])
    return key[sent], owner[visit[sent]]


_DESCRIBED = "doc_id long, n_shingles long, set_name binary, low long, bin int, keys binary, lows binary, shared binary, more boolean"


def _described(bins: int, words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
        names = [c.split()[0] for c in _DESCRIBED.split(", ")]

        def table(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names
            )

        for batch in pieces(batches):
            sets = shingle_sets(batch.column(1), words)
            name = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            low = [int.from_bytes(n[:8], "little", signed=True) if n else None for n in name]
            yield table(len(sets), doc_id=batch.column(0), n_shingles=[len(s) for s in sets], set_name=name, low=low)
            here: dict[bytes, int] = {}
            ids = batch.column(0).to_pylist()
            for i, own in enumerate(name):  # one of equal sets, and of rows with an id
                if own is not None and ids[i] is not None:
                    here.setdefault(own, i)
            mine = list(here.values())
            key, owner = block_keys([sets[i] for i in mine], percent)
            lows = np.array([low[i] for i in mine], np.int64)[owner] if mine else np.empty(0, np.int64)
            order = np.lexsort((lows, key))
            key, lows = key[order], lows[order]
            # a bucket with two sets of this piece is known: one of them goes on, marked, the others need no look
            new = np.append(True, key[1:] != key[:-1]) if len(key) else np.empty(0, bool)
            shared = np.append(~new[1:], False) & new if len(key) else new
            if (~new).any():
                rest = np.flatnonzero(~new)
                yield table(1, keys=[key[rest].tobytes()], lows=[lows[rest].tobytes()], more=[True])
            bin_of = (key >> np.uint64(20)) % np.uint64(bins)
            for b in np.unique(bin_of):
                sent = np.flatnonzero((bin_of == b) & new)
                if len(sent):
                    yield table(1, bin=[int(b)], keys=[key[sent].tobytes()], lows=[lows[sent].tobytes()], shared=[shared[sent].tobytes()], more=[False])

    return run


def _rows(key: np.ndarray, low: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"key": key.view(np.int64), "low": low})


def _shared(_: tuple, group: pd.DataFrame) -> pd.DataFrame:
    key = np.frombuffer(b"".join(group["keys"]), np.uint64)
    low = np.frombuffer(b"".join(group["lows"]), np.int64)
    known = np.frombuffer(b"".join(group["shared"]), bool)
    order = np.lexsort((low, key))
    key, low, known = key[order], low[order], known[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    many = (np.maximum.reduceat(low, starts) != np.minimum.reduceat(low, starts)) | np.logical_or.reduceat(known, starts)
    keep = np.repeat(many, sizes)
    return _rows(key[keep], low[keep])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, lows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_pandas(_rows(np.frombuffer(keys, np.uint64), np.frombuffer(lows, np.int64)), preserve_index=False)


def _full(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = shingle_sets(batch.column(1), words)
            sizes = np.array([len(s) for s in sets], np.int64)
            short = parities(np.concatenate(sets) if sets else np.empty(0, np.uint64), np.repeat(np.arange(len(sets)), sizes), len(sets), _SHORT)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes),
                    pa.array([row.tobytes() for row in short], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                ["doc_id", "n", "short", "shingles"],
            )

    return run


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, _SHORT)


def possible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of two tables of short sketches can belong to linked sets, by size and differing bits."""
    near = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return near & (np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= most_apart(n_a + n_b, percent))


def _likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(i).to_pylist()) for i in (2, 3))
            n_a, n_b = (batch.column(i).to_numpy() for i in (4, 5))
            keep = possible(a, b, n_a, n_b, percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(p) + len(q) - len(np.unique(np.concatenate((p, q))))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sides(group: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return group[group.side == 0], group[group.side == 1]


def _open(p: pd.DataFrame, q: pd.DataFrame, percent: int) -> np.ndarray:
    """Which members of different components sizes and short sketches leave possible, p by q."""
    out = np.zeros((len(p), len(q)), bool)
    short_p, short_q = _matrix(p.short), _matrix(q.short)
    n_p, n_q, label_p, label_q = (x.to_numpy() for x in (p.n, q.n, p.label, q.label))
    for row in range(len(p)):
        out[row] = possible(short_p[row], short_q, n_p[row], n_q, percent) & (label_q != label_p[row])
    return out


def _flagged(percent: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        p, q = _sides(group)
        open_ = _open(p, q, percent)
        ids = np.unique(np.append(p.doc_id.to_numpy()[open_.any(1)], q.doc_id.to_numpy()[open_.any(0)]))
        return pd.DataFrame({"hub": np.full(len(ids), key[0], np.int64), "doc_id": ids})

    return run


def _verified(percent: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        p, q = _sides(group)
        out: list[tuple[int, int]] = []
        open_ = _open(p, q, percent)
        if open_.any():
            both = overlaps(*([np.frombuffer(s, np.uint64) for s in side.shingles] for side in (p, q)))
            n_p, n_q = p.n.to_numpy()[:, None], q.n.to_numpy()
            open_ &= 100 * both >= percent * (n_p + n_q - both)
            out = joining(open_, p.doc_id.to_numpy(), p.label.to_numpy(), q.doc_id.to_numpy(), q.label.to_numpy())
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _dealt(members: DataFrame, rows: int, shingles: int | None) -> DataFrame:
    """Members (hub, doc_id, label, n, ...) in blocks (hub, i, j): those outside a hub's largest component, and all."""
    by_label = members.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("_n"), F.sum("n").alias("_w"))
    top = F.max(F.struct("_n", "label", "_w"))
    width = F.lit(shingles if shingles else 1 << 62)
    count = [
        F.ceil(F.greatest(n / rows, w / width)).cast("bigint").alias(name)
        for name, n, w in (("_every", F.col("_n"), F.col("_w")), ("_apart", F.col("_n") - F.col("_top._n"), F.col("_w") - F.col("_top._w")))
    ]
    open_ = (
        by_label.groupBy("hub")
        .agg(F.count(F.lit(1)).alias("_labels"), F.sum("_n").alias("_n"), F.sum("_w").alias("_w"), top.alias("_top"))
        .where("_labels > 1")
        .select("hub", F.col("_top.label").alias("_main"), *count)
    )
    members = members.join(open_, "hub")
    own, zero, one = F.xxhash64("doc_id", "hub"), F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def spread(n: str):
        return F.explode(F.sequence(zero, F.greatest(F.col(n), one) - one))

    columns = [c for c in members.columns if not c.startswith("_")]
    apart = members.where("label <> _main").select(*columns, F.lit(0).alias("side"), F.pmod(own, "_apart").alias("i"), spread("_every").alias("j"))
    every = members.select(*columns, F.lit(1).alias("side"), spread("_apart").alias("i"), F.pmod(own, "_every").alias("j"))
    return apart.unionByName(every)


def _apart_links(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Exact links between members of a hub that are in different components so far."""
    node = labels.selectExpr("node AS doc_id", "component AS label")
    members = members.join(node, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    many = members.groupBy("hub").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a < _b").select("hub")
    members = stage(members.join(many, "hub"), "join-open")
    near = _dealt(members.join(sets.select("doc_id", "n", "short"), "doc_id"), _SKETCHES, None)
    flagged = stage(near.groupBy("hub", "i", "j").applyInPandas(_flagged(percent), "hub long, doc_id long").distinct(), "join-flagged")
    full = _dealt(members.join(flagged, ["hub", "doc_id"]).join(sets, "doc_id"), _SETS, _SET_SHINGLES)
    return stage(full.groupBy("hub", "i", "j").applyInPandas(_verified(percent), "a long, b long").distinct(), "join-apart")


def similar_documents(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least ``percent`` of 100.

    Reads ``doc_id`` and ``text`` (null: empty), ignores other columns. Shingles
    are ``words`` words, A-Z in small letters, hashed to 64 bits; fewer words are one shingle. Returns per row
    doc_id, n_shingles and component_id, the least doc_id reachable by links. A
    text without words is linked with nothing. Rows that share an id are one
    node; rows without one are linked with nothing and have no component. An
    empty table gives an empty result. ``percent`` is over 50.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    made = stage(docs.mapInArrow(_described(max(1, size // (_ROW_BYTES * _BIN_ROWS)), words, percent), _DESCRIBED), "join-described")
    described = made.where("n_shingles IS NOT NULL").select("doc_id", "n_shingles", "set_name", "low")
    packed = made.where("more IS NOT NULL")
    buckets = (
        packed.where("NOT more")
        .select("bin", "keys", "lows", "shared")
        .groupBy("bin")
        .applyInPandas(_shared, "key long, low long")
        .unionByName(packed.where("more").select("keys", "lows").mapInArrow(_unpacked, "key long, low long"))
        .distinct()
    )
    named = described.where("set_name IS NOT NULL AND doc_id IS NOT NULL")
    classes = stage(named.groupBy("set_name", "low").agg(F.min("doc_id").alias("first")), "join-classes")
    buckets = stage(buckets.join(classes.select("low", "first"), "low").select("key", F.col("first").alias("doc_id")).distinct(), "join-buckets")
    hubs = buckets.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("_last")).where("hub < _last").select("key", "hub")
    members = stage(buckets.join(hubs, "key").where("doc_id > hub").select("hub", "doc_id").distinct(), "join-members")
    ids = stage(members.select(F.explode(F.array("hub", "doc_id")).alias("doc_id")).distinct(), "join-ids")
    sets = stage(bounded_join(docs, ids, "doc_id", "left_semi").mapInArrow(_full(words), "doc_id long, n long, short binary, shingles binary"), "join-sets")

    side = sets.select("doc_id", "short", "n")
    likely = (
        members.selectExpr("hub AS a", "doc_id AS b")
        .join(side.toDF("a", "short_a", "n_a"), "a")
        .join(side.toDF("b", "short_b", "n_b"), "b")
        .select("a", "b", "short_a", "short_b", "n_a", "n_b")
        .mapInArrow(_likely(percent), "a long, b long")
    )
    likely = stage(likely.distinct(), "join-likely")
    full = sets.select("doc_id", "shingles")
    links = (
        likely.join(full.toDF("a", "set_a"), "a")
        .join(full.toDF("b", "set_b"), "b")
        .select("a", "b", "set_a", "set_b")
        .mapInArrow(_linked(percent), "a long, b long")
    )
    # rows of one id but different sets tie their classes together
    classed = described.join(classes.select("set_name", F.col("first").alias("_class")), "set_name", "left")
    own = classed.where("_class IS NOT NULL AND doc_id IS NOT NULL AND _class <> doc_id")
    twice = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id")
    ties = own.join(twice, "doc_id").selectExpr("_class AS a", "doc_id AS b")
    links = stage(links.unionByName(ties), "join-links")
    labels = components(links)
    apart = _apart_links(members, sets, labels, percent)
    if not apart.isEmpty():
        labels = components(links.unionByName(apart))
    place = F.when(F.col("doc_id").isNotNull(), F.coalesce("_class", "doc_id"))
    return (
        classed.withColumn("_place", place)
        .join(labels.selectExpr("node AS _place", "component"), "_place", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "_place").alias("component_id"))
    )
