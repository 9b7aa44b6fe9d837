"""Near-duplicates by MinHash bands with sequential Bayesian verification.

Equal shingle sets are one class from the start. Each class has a signature of
``HASHES`` minima, cut into bands; classes that share a band are candidates. A
candidate pair's signatures are compared batch by batch, and the pair is dropped
as soon as the chance, given the matches so far, that its similarity reaches the
bound is below ``MISS``; survivors are compared on their full shingle sets.

Pairs of a bucket are not all listed. Each member is first compared with the
bucket's least; what the links join is settled. Members still apart are then
compared with every member of another component, block against block: signatures
prune and full sets verify within a block, and only links that join leave it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.components import components
from tandem.llm.tables import bounded_join, unused
from tandem.llm.words import KEPT, WordHashes, slices, text_bytes
from tandem.operators.ordinals import with_ordinals
from tandem.session import stage

WORDS, PERCENT = 5, 85
BANDS, ROWS = 24, 6
HASHES = BANDS * ROWS
BATCH = 24
#: Bands whose stars are compared first, and settle most of a large group.
FIRST_BANDS = 3
#: Chosen chance that a pair at the bound is dropped by its signatures at one batch.
MISS = 1e-5
#: Members and shingles of one side of a block of an unsettled bucket, and shingles counted at once.
_BLOCK, _BLOCK_SHINGLES, _COLUMNS = 256, 1 << 20, 1 << 12

_ODD = np.uint64(0x9E3779B97F4A7C15)
_HASHES = WordHashes()
#: The name of that table among those a worker keeps.
_TABLE = "shingle words"
KEPT[_TABLE] = _HASHES.clear


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; bytes.lower() lowers A-Z alone."""
    own = text.lower().split()
    if not own:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(_HASHES.__getitem__, own), np.uint64, len(own))
    width = min(words, len(own))
    rolled = np.full(len(own) - width + 1, np.uint64(width))
    for k in range(width):
        rolled = rolled * _ODD + codes[k : len(own) - width + 1 + k]
    return np.unique(mixed(rolled))


@functools.cache
def multipliers(n: int = HASHES) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _ODD) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of HASHES 32-bit minima per non-empty set."""
    out = np.empty((len(sets), HASHES), np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 1 << 17):
            size += len(sets[end])
            end += 1
        values = np.concatenate(sets[at:end])
        starts = np.cumsum([0] + [len(s) for s in sets[at : end - 1]])
        for k, factor in enumerate(multipliers()):
            out[at:end, k] = np.minimum.reduceat(values * factor, starts) >> np.uint64(32)
        at = end
    return out


@functools.cache
def least_matches(bound: float, miss: float = MISS) -> tuple[int, ...]:
    """For each number of compared hashes, a batch apart, the matches below which a pair is dropped.

    With a uniform prior, m matches of n leave a Beta(m + 1, n - m + 1) belief;
    its upper tail at ``bound`` is a binomial sum. Candidates share a band, which
    only raises m, so the rule errs towards keeping a pair.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * bound**m * (1 - bound) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survives(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Which rows of two signature tables are still likely to reach the bound after every batch."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for k, least in enumerate(least_matches(bound)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, table=_TABLE):
        sets = [shingles(t) for t in text_bytes(batch)]
        full = [i for i, s in enumerate(sets) if len(s)]
        names: list = [None] * len(sets)
        signed: list = [None] * len(sets)
        if full:
            for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                names[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                signed[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(names, pa.binary()),
                pa.array(signed, pa.binary()),
            ],
            ["doc_id", "n_shingles", "set_name", "signature"],
        )


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_name, signature) of each row; names and signatures of empty sets are null."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _described, "doc_id long, n_shingles long, set_name binary, signature binary"
    )


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, HASHES)


def _likely(bound: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(i).to_pylist()) for i in (2, 3))
            na, nb = (batch.column(i).to_numpy() for i in (4, 5))
            keep = survives(a, b, bound) & (np.minimum(na, nb) >= bound * np.maximum(na, nb) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def likely_pairs(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and signatures leave possible."""
    side = signed.select("doc_id", "signature", "n_shingles")
    left = side.toDF("a", "sig_a", "n_a")
    right = side.toDF("b", "sig_b", "n_b")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", "sig_a", "sig_b", "n_a", "n_b")
        .mapInArrow(_likely(percent / 100), "a long, b long")
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, table=_TABLE):
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([shingles(t).tobytes() for t in text_bytes(batch)], pa.binary())],
            ["doc_id", "shingles"],
        )


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256, _TABLE):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(p) + len(q) - len(np.unique(np.concatenate((p, q))))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles): the full sets of the documents with the staged ``ids``."""
    wanted = bounded_join(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ids, "doc_id", "left_semi"
    )
    return wanted.mapInArrow(_sets, "doc_id long, shingles binary")


def exact_links(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The staged ``pairs`` whose full shingle sets reach the bound."""
    ids = stage(pairs.selectExpr("explode(array(a, b)) AS doc_id").distinct(), "likely-ids")
    sets = stage(shingle_sets(docs, ids), "likely-sets")
    return (
        pairs.join(sets.toDF("a", "set_a"), "a")
        .join(sets.toDF("b", "set_b"), "b")
        .select("a", "b", "set_a", "set_b")
        .mapInArrow(_linked(percent), "a long, b long")
    )


def overlaps(p: list[np.ndarray], q: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``p`` shares with each of ``q``."""
    sets = p + q
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    owner, code = owner[shared[code]], place[code[shared[code]]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(p), len(q)), np.float64)
    for low in range(0, int(shared.sum()), _COLUMNS):
        part = slice(*np.searchsorted(code, (low, low + _COLUMNS)))
        held = np.zeros((len(sets), min(_COLUMNS, int(shared.sum()) - low)), np.float32)
        held[owner[part], code[part] - low] = 1
        out += held[: len(p)] @ held[len(p) :].T
    return out.astype(np.int64)


def _blocks(percent: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        apart, every = group[group.side == 0], group[group.side == 1]
        out: list[tuple[int, int]] = []
        if len(apart) and len(every):
            n_p, n_q = apart.n_shingles.to_numpy()[:, None], every.n_shingles.to_numpy()
            label_p, label_q = apart.label.to_numpy(), every.label.to_numpy()
            open_ = (label_p[:, None] != label_q) & (
                100 * np.minimum(n_p, n_q) >= percent * np.maximum(n_p, n_q)
            )
            sig_p, sig_q = _matrix(apart.signature), _matrix(every.signature)
            for row, mask in enumerate(open_):
                other = np.flatnonzero(mask)
                own = np.broadcast_to(sig_p[row], (len(other), HASHES))
                mask[other] = survives(own, sig_q[other], percent / 100)
            if open_.any():
                both = overlaps(
                    *([np.frombuffer(s, np.uint64) for s in side.shingles] for side in (apart, every))
                )
                open_ &= 100 * both >= percent * (n_p + n_q - both)
            out = joining(open_, apart.doc_id.to_numpy(), label_p, every.doc_id.to_numpy(), label_q)
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def joining(linked: np.ndarray, ids_p, label_p, ids_q, label_q) -> list[tuple[int, int]]:
    """Of the links of a block, those that join labels not joined by earlier ones."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for row in np.flatnonzero(linked.any(1)):
        other = np.flatnonzero(linked[row])
        labels, first = np.unique(label_q[other], return_index=True)
        for label, at in zip(labels.tolist(), other[first].tolist(), strict=True):
            a, b = root(int(label_p[row])), root(label)
            if a != b:
                parent[a] = b
                out.append((int(ids_p[row]), int(ids_q[at])))
    return out


def _rest(docs: DataFrame, buckets: DataFrame, labels: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Exact links between members of a bucket that its least member did not bring together.

    Every member outside a bucket's largest component meets every other member in one
    block, which keeps signatures and full sets side by side: pairs that survive the
    signatures are verified there, and only links that join components leave it.
    """
    members = buckets.select("doc_id", "band", "hub").join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    # a bucket is settled if all but its least member, already compared with each, are in one component
    others = members.where("doc_id <> hub").join(signed, "doc_id")
    by_label = others.groupBy("band", "label").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_w")
    )
    largest = F.max(F.struct("_n", "label", "_w"))
    open_ = (
        by_label.groupBy("band")
        .agg(F.count(F.lit(1)).alias("_labels"), F.sum("_n").alias("_n"), F.sum("_w").alias("_w"), largest.alias("_top"))
        .where("_labels > 1")
        .select(
            "band",
            F.col("_top.label").alias("_main"),
            *(
                F.ceil(F.greatest(n / _BLOCK, w / _BLOCK_SHINGLES)).cast("bigint").alias(name)
                for name, n, w in (
                    ("_every", F.col("_n"), F.col("_w")),
                    ("_apart", F.col("_n") - F.col("_top._n"), F.col("_w") - F.col("_top._w")),
                )
            ),
        )
    )
    members = stage(others.join(open_, "band").drop("hub"), "open-buckets")
    ids = stage(members.select("doc_id").distinct(), "open-ids")
    sets = stage(shingle_sets(docs, ids), "open-sets")
    members = members.join(sets, "doc_id")
    row = ["band", "doc_id", "label", "signature", "n_shingles", "shingles"]
    own = F.xxhash64("doc_id", "band")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    apart = members.where("label <> _main").select(
        *row, F.lit(0).alias("side"), F.pmod(own, "_apart").alias("i"), F.explode(F.sequence(zero, F.col("_every") - one)).alias("j")
    )
    every = members.select(
        *row, F.lit(1).alias("side"), F.explode(F.sequence(zero, F.col("_apart") - one)).alias("i"), F.pmod(own, "_every").alias("j")
    )
    return apart.unionByName(every).groupBy("band", "i", "j").applyInPandas(_blocks(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least ``percent`` of 100.

    Reads ``doc_id`` and ``text`` (null: empty), ignores other columns. Shingles
    are five words, lower-cased in A-Z, hashed to 64 bits. Returns per row
    doc_id, n_shingles, component_id (least doc_id reachable) and kept. A text
    without words is linked with nothing; a shorter text than a shingle is one
    shingle. Rows that share an id are one node, and rows without one are linked
    with nothing and kept. An empty table gives an empty result.
    """
    described = stage(describe(docs), "minhash")
    classes = stage(
        described.where("set_name IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("set_name")
        .agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("_n")),
        "minhash-classes",
    )
    signed = described.join(classes.select("set_name", "doc_id"), ["set_name", "doc_id"]).dropDuplicates(["set_name", "doc_id"])
    signed = stage(signed.select("doc_id", "n_shingles", "signature"), "minhash-signed")

    width = 4 * ROWS
    band = [
        F.xxhash64(F.lit(k), F.substring("signature", k * width + 1, width)) for k in range(BANDS)
    ]
    banded = signed.select("doc_id", F.posexplode(F.array(*band)).alias("_band", "band"))
    shared = banded.groupBy("band").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("_last"))
    buckets = stage(
        banded.join(shared.where("hub < _last").select("band", "hub"), "band"), "minhash-buckets"
    )
    stars = buckets.where("doc_id <> hub").selectExpr("_band", "hub AS a", "doc_id AS b")
    # a few bands first: what they join need not be compared again in the others
    likely = stage(likely_pairs(stars.where(F.col("_band") < FIRST_BANDS).select("a", "b").distinct(), signed, percent), "likely")
    links = stage(exact_links(docs, likely, percent).unionByName(_ties(described, classes)), "exact-links")
    labels = components(links)
    of_a, of_b = (labels.toDF(x, f"_label_{x}") for x in "ab")
    apart = (
        stars.where(F.col("_band") >= FIRST_BANDS)
        .join(of_a, "a", "left")
        .join(of_b, "b", "left")
        .where("coalesce(_label_a, a) <> coalesce(_label_b, b)")
        .select("a", "b")
        .distinct()
    )
    likely = stage(likely_pairs(apart, signed, percent), "likely")
    links = stage(links.unionByName(exact_links(docs, likely, percent)), "exact-links")
    labels = components(links)
    settled = labels.selectExpr("node AS doc_id", "component AS label")
    rest = stage(_rest(docs, buckets, settled, signed, percent), "rest-links")
    if not rest.isEmpty():
        labels = components(links.unionByName(rest))

    ids = described.select("doc_id", "n_shingles", "set_name")
    named = F.when(F.col("doc_id").isNotNull(), F.col("set_name"))
    tied = ids.withColumn("set_name", named).join(
        classes.select("set_name", F.col("doc_id").alias("_class")), "set_name", "left"
    )
    labels = labels.selectExpr("node AS _class", "component")
    return tied.join(labels, "_class", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "_class", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component", "_class", "doc_id")).alias("kept"),
    )


def _ties(described: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id but not their text."""
    named = described.where("set_name IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "set_name")
    twice = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id")
    of_id = named.join(twice, "doc_id").join(classes.select("set_name", F.col("doc_id").alias("_class")), "set_name")
    return of_id.where("_class <> doc_id").selectExpr("_class AS a", "doc_id AS b").distinct()


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their own columns.

    Rows that share an id but not their text are documents of their own here:
    each goes only if its own text is linked with a kept one.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    twice = stage(rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "near-twice")
    if twice.isEmpty():
        (mine,) = unused(docs, "_gone_id")
        gone = stage(near_duplicates(docs, percent).where("NOT kept").select("doc_id").distinct().toDF(mine), "near")
        return bounded_join(docs, gone, F.col("doc_id").cast("bigint") == F.col(mine), "left_anti")
    name = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    each = rows.where("doc_id IS NOT NULL").select("doc_id", name.alias("_name")).distinct()
    numbered = stage(with_ordinals(each, ["doc_id", "_name"], "_number"), "near-numbers")
    own = rows.withColumn("_name", name).join(numbered, ["doc_id", "_name"])
    found = near_duplicates(own.select(F.col("_number").alias("doc_id"), "text"), percent)
    mine = unused(docs, "_gone_id", "_gone_name")
    gone = found.where("NOT kept").select(F.col("doc_id").alias("_number")).distinct().join(numbered, "_number").select("doc_id", "_name")
    gone = stage(gone.toDF(*mine), "near")
    return bounded_join(docs, gone, (F.col("doc_id").cast("bigint") == F.col(mine[0])) & (name == F.col(mine[1])), "left_anti")
