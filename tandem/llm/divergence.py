"""How the sources of a language differ in their words, by a minimal-perfect-hash recount.

1. The documents that hold a term are counted exactly, by language; terms in too
   few of them go.
2. The kept terms are cut by hash into shards of bounded size, and each shard gets
   a minimal perfect hash that keeps its terms. Shards are sent to the workers in
   rounds of bounded size.
3. Texts are read again. Each distinct word of a piece of text is looked up once,
   and is counted only if the stored term is that word. The occurrences of a
   shard are added to dense slots, one row of them per (language, source) group.
4. Every kept term then has one row with its count in each group, from which exact
   shares in billionths and the divergences between groups follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.perfect_hash import Shard, ShardedHash, build, key_hashes
from tandem.llm.words import LETTERS, cut, pieces
from tandem.session import stage

#: Documents of its language that hold a kept term, and ranks listed of a group's terms.
LEAST_DOCS, TOP = 3, 200
#: Terms of a shard (about), bytes of the shards sent at once, and occurrences a worker gathers before it adds them up.
SHARD_TERMS, ROUND_BYTES, GATHERED = 16_384, 64 << 20, 4_000_000
#: Cells (terms by groups) of a dense table of counts, and parts of a group's terms ranked apart first.
_CELLS, _PARTS = 1 << 20, 64
_PIECE = 8 << 20
_BILLION_STEPS = (1000, 1000, 1000)


def _lang_seed(lang: str) -> int:
    """What Spark's xxhash64 has reached after a language, with its seed of 42."""
    return xxhash.xxh64_intdigest(lang.encode(), 42)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    langs = batch.column(batch.schema.get_field_index("lang")).dictionary_encode()
    codes = langs.indices.to_numpy(zero_copy_only=False)
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, np.flatnonzero(codes == k)


def _coded(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, the term of each occurrence, the row of each occurrence)."""
    words, counts = cut(batch.column(batch.schema.get_field_index("text")), LETTERS)
    words = words.dictionary_encode()
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(counts)), counts)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, documents of this piece that hold it)."""
    for batch in pieces(batches, most=_PIECE):
        terms, codes, rows = _coded(batch)
        lang_of = np.zeros(batch.num_rows, np.int64)
        names = []
        for lang, own in _by_lang(batch):
            lang_of[own] = len(names)
            names.append(lang)
        n = max(1, len(terms))
        once = np.unique(rows * n + codes)
        keys, counts = np.unique(lang_of[once // n] * n + once % n, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()).take(pa.array(keys // n)),
                terms.take(pa.array(keys % n)).cast(pa.string()),
                pa.array(counts, pa.int64()),
            ],
            ["lang", "term", "n"],
        )


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term) of terms that at least ``least_docs`` documents of the language hold."""
    held = docs.select("lang", "text").mapInArrow(_held, "lang string, term string, n long")
    return held.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs).select("lang", "term")


def _built(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    lang, shard = key
    terms = [t.encode() for t in group.term]
    seed = _lang_seed(lang)
    turn, sizes, bits, order = build(terms, seed)
    terms = [terms[i] for i in order]
    ends = np.cumsum([len(t) for t in terms]).astype("<i4").tobytes()
    return pd.DataFrame(
        {"lang": [lang], "shard": [shard], "n": [len(terms)], "turn": [turn], "sizes": [sizes], "bits": [bits], "keys": [b"".join(terms)], "ends": [ends]}
    )


def term_shards(kept: DataFrame, sizes: dict[str, int], shard_terms: int = SHARD_TERMS) -> DataFrame:
    """One row per shard of a language's kept terms: its perfect hash and its terms in slot order."""
    shards = {lang: max(1, -(-n // shard_terms)) for lang, n in sizes.items()}
    of_lang = kept.sparkSession.createDataFrame(list(shards.items()), "lang string, _shards long")
    # the workers take the same remainder of the same hash
    number = F.shiftrightunsigned(F.xxhash64("lang", "term"), 1) % F.col("_shards")
    return (
        kept.join(F.broadcast(of_lang), "lang")
        .select("lang", number.alias("shard"), "term")
        .groupBy("lang", "shard")
        .applyInPandas(_built, "lang string, shard long, n long, turn int, sizes array<int>, bits binary, keys binary, ends binary")
    )


def _counted(shared, groups: dict[tuple[str, str], int], first_slots: list[int], shards: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: ShardedHash = shared.value
        first = np.array(first_slots, np.int64)
        firsts, row_of = table.firsts, table.row
        gathered: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            """The gathered (group, slot, times), added up in the dense slots of one shard after another."""
            group, slot, times = np.concatenate(gathered, axis=1)
            gathered.clear()
            shard = np.searchsorted(firsts, slot, "right") - 1
            order = np.argsort(shard, kind="stable")
            group, slot, times, shard = group[order], slot[order], times[order], shard[order]
            cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            out = []
            for start, end in zip(cuts, np.append(cuts[1:], len(shard)), strict=True):
                s = shard[start]
                width = int(firsts[s + 1] - firsts[s])
                own, line = np.unique(group[start:end], return_inverse=True)
                inside = slot[start:end] - firsts[s]
                for low in range(0, len(own), max(1, _CELLS // width)):
                    high = min(len(own), low + max(1, _CELLS // width))
                    mine = (line >= low) & (line < high)
                    dense = np.zeros((high - low, width), np.int64)
                    np.add.at(dense, (line[mine] - low, inside[mine]), times[start:end][mine])
                    g, at = np.nonzero(dense)
                    out.append((first[s] + at, own[low + g], dense[g, at]))
            slots, ids, counts = (np.concatenate(c) for c in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(slots, pa.int64()), pa.array(ids.astype(np.int32)), pa.array(counts, pa.int64())], ["slot", "gid", "n"]
            )

        for batch in pieces(batches, most=_PIECE):
            terms, codes, rows = _coded(batch)
            sources = batch.column(batch.schema.get_field_index("source")).to_pylist()
            for lang, own in _by_lang(batch):
                if lang not in shards:
                    continue
                gid = np.full(batch.num_rows, -1, np.int64)
                gid[own] = [groups[lang, sources[i]] for i in own.tolist()]
                mine = gid[rows] >= 0
                pair, times = np.unique(gid[rows[mine]] * len(terms) + codes[mine], return_counts=True)
                used, place = np.unique(pair % max(1, len(terms)), return_inverse=True)
                words = terms.take(pa.array(used))
                hashes = key_hashes(words.to_pylist(), _lang_seed(lang))
                number = (hashes >> np.uint64(1)) % np.uint64(shards[lang])
                line = np.full(shards[lang], -1, np.int64)
                for k in range(shards[lang]):
                    line[k] = row_of.get((lang, k), -1)
                slot = table.slots(words, line[number.astype(np.int64)], hashes)[place]
                known = slot >= 0
                gathered.append(np.stack([pair[known] // max(1, len(terms)), slot[known], times[known]]))
            if sum(g.shape[1] for g in gathered) >= GATHERED:
                yield summed()
        if sum(g.shape[1] for g in gathered):
            yield summed()

    return run


def recount(docs: DataFrame, shards: DataFrame, groups: dict[tuple[str, str], int], sizes: dict[str, int], shard_terms: int, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(slot, cells): for each kept term, by slot, its count in each group (gid, n) that holds it.

    Slots are numbered through all shards, by (lang, shard). Each round sends
    shards of at most ``round_bytes`` (one at least) and reads the texts once.
    """
    spark = docs.sparkSession
    per_lang = {lang: max(1, -(-n // shard_terms)) for lang, n in sizes.items()}
    length = (F.length("bits") + F.length("keys") + F.length("ends")).alias("bytes")
    listed = shards.select("line", "lang", "first", length).orderBy("line").toPandas()  # one row per shard
    counted = None
    at = 0
    while at < len(listed):
        end, size = at, 0
        while end < len(listed) and (end == at or size + listed.bytes[end] <= round_bytes):
            size += int(listed.bytes[end])
            end += 1
        sent = [
            Shard(r.lang, r.shard, _lang_seed(r.lang), r.turn, r.sizes, bytes(r.bits), bytes(r.keys), bytes(r.ends))
            for r in shards.where(F.col("line").between(at + 1, end)).orderBy("line").toLocalIterator()
        ]
        shared = spark.sparkContext.broadcast(ShardedHash(sent))
        here = set(listed.lang[at:end])
        part = docs.select("lang", "source", "text").mapInArrow(
            _counted(shared, {k: v for k, v in groups.items() if k[0] in here}, listed["first"][at:end].tolist(), {k: v for k, v in per_lang.items() if k in here}),
            "slot long, gid int, n long",
        )
        counted = part if counted is None else counted.unionByName(part)
        at = end
    if counted is None:
        counted = spark.createDataFrame([], "slot long, gid int, n long")
    # workers have added up what they met; a term's rows move once
    cells = counted.repartition("slot").groupBy("slot", "gid").agg(F.sum("n").alias("n"))
    return cells.groupBy("slot").agg(F.collect_list(F.struct("gid", "n")).alias("cells"))  # at most one per group


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, lang, term) of each shard's terms."""
    for batch in batches:
        for lang, first, keys, ends in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            ends = np.frombuffer(ends, np.int32)
            terms = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(np.int32(0), ends)), pa.py_buffer(keys)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(first, first + len(ends))), pa.array([lang] * len(ends), pa.string()), terms.cast(pa.string())],
                ["slot", "lang", "term"],
            )


def shares(counts: np.ndarray, totals: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total) by long division; exact for totals under 9 * 10^15."""
    rest, out = counts + 1, np.zeros_like(counts)
    whole, rest = rest // totals, rest % totals
    out = whole
    for step in _BILLION_STEPS:
        out, rest = out * step + rest * step // totals, rest * step % totals
    return out + 1


class _Groups:
    """The groups and, of each, its language's line, and all totals; one entry per (lang, source)."""

    def __init__(self, groups: dict[tuple[str, str], int], sizes: dict[str, int], totals: dict[int, int]):
        by_lang: dict[str, list[int]] = {}
        for (lang, _), gid in groups.items():
            by_lang.setdefault(lang, []).append(gid)
        self.by_lang = {k: np.array(sorted(v), np.int64) for k, v in by_lang.items()}
        # the sums' last part: N + V of each group, and of each language
        self.total = {gid: totals.get(gid, 0) + sizes.get(lang, 0) for (lang, _), gid in groups.items()}
        self.lang_total = {k: sum(totals.get(int(g), 0) for g in v) + sizes.get(k, 0) for k, v in self.by_lang.items()}

    def dense(self, lang: str, cells: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, counts by row and group of the language), a bounded number of cells at a time."""
        own = self.by_lang[lang]
        step = max(1, _CELLS // len(own))
        for low in range(0, len(cells), step):
            part = cells.slice(low, step)
            flat = part.flatten()
            rows = np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy(zero_copy_only=False))
            out = np.zeros((len(part), len(own)), np.int64)
            out[rows, np.searchsorted(own, flat.field(0).to_numpy(zero_copy_only=False))] = flat.field(1).to_numpy(zero_copy_only=False)
            yield low, out

    def totals(self, lang: str) -> np.ndarray:
        return np.array([self.total[int(g)] for g in self.by_lang[lang]], np.int64)


def _pairs(groups: _Groups):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            cells = batch.column(batch.schema.get_field_index("cells"))
            for lang, own in _by_lang(batch):
                n = len(groups.by_lang[lang])
                total = sums.setdefault(lang, np.zeros((n, n), np.int64))
                for _, counts in groups.dense(lang, cells.take(pa.array(own))):
                    p = shares(counts, groups.totals(lang))
                    for k in range(n):
                        apart = p[:, [k]] - p
                        total[k] += (apart * apart // p).sum(0)
        for lang, total in sums.items():
            own = groups.by_lang[lang]
            a, b = np.nonzero(~np.eye(len(own), dtype=bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[a], pa.int64()), pa.array(own[b], pa.int64()), pa.array(total[a, b], pa.int64())], ["gid", "other", "value"]
            )

    return run


def _peaks(groups: _Groups, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(batch.schema.get_field_index("cells"))
            terms = batch.column(batch.schema.get_field_index("term"))
            for lang, own in _by_lang(batch):
                totals, ids = groups.totals(lang), groups.by_lang[lang]
                found = []
                for low, counts in groups.dense(lang, cells.take(pa.array(own))):
                    p, q = shares(counts, totals), shares(counts.sum(1, keepdims=True), groups.lang_total[lang])
                    row, g = np.nonzero((counts > 0) & (p > q))
                    apart, q = p[row, g] - q[row, 0], q[row, 0]
                    found.append((ids[g], own[low + row], apart * apart // q))
                gid, row, value = (np.concatenate(c) for c in zip(*found, strict=True))
                # of each group, terms that may be among the first: those of at least the top-th value here
                order = np.lexsort((-value, gid))
                gid, row, value = gid[order], row[order], value[order]
                starts = np.flatnonzero(np.append(True, gid[1:] != gid[:-1])) if len(gid) else np.empty(0, np.int64)
                sizes = np.diff(np.append(starts, len(gid)))
                least = np.repeat(np.where(sizes >= top, value[np.minimum(starts + top - 1, max(0, len(value) - 1))], np.iinfo(np.int64).min) if len(gid) else value, sizes)
                keep = value >= least
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gid[keep], pa.int64()), terms.take(pa.array(row[keep])), pa.array(value[keep], pa.int64())], ["gid", "item", "value"]
                )

    return run


def source_divergence(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    top: int = TOP,
    shard_terms: int = SHARD_TERMS,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """How each source of a language differs from its other sources, and the terms that mark it.

    Reads ``text``, ``lang`` and ``source`` of every row (null: ''), ignores other
    columns. Terms are runs of ASCII letters and of signs beyond ASCII, A-Z in
    small letters; a language keeps the V terms that at least ``least_docs`` of its
    rows hold. A group's share of a term is p = 1 + floor(10^9 (count + 1) / (N + V)),
    and f = floor((p - q)^2 / q). Rows: part ``pair`` with item another source of the language and
    value the sum of f over all kept terms, and part ``term`` with the group's terms
    of more than the language's share, only ranks to ``top``. Ranks go by falling
    value, then item. Repeated rows count each; texts without terms only make
    their group occur; an empty table gives an empty result.

    The driver holds one number per (lang, source) group, the square root of the
    result, and one line per shard.
    """
    spark = docs.sparkSession
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = {(r.lang, r.source): i for i, r in enumerate(docs.select("lang", "source").distinct().orderBy("lang", "source").collect())}
    names = spark.createDataFrame([(g, lang, source) for (lang, source), g in groups.items()], "gid long, lang string, source string")
    kept = stage(kept_terms(docs, least_docs), "kept-terms")
    sizes = {r.lang: r["count"] for r in kept.groupBy("lang").count().collect()}
    shards = stage(term_shards(kept, sizes, shard_terms), "term-shards")
    # one row per shard gets its line and its first slot
    order = Window.orderBy("lang", "shard")
    lines = shards.select(
        "lang",
        "shard",
        F.row_number().over(order).alias("line"),
        F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"),
    )
    shards = shards.join(F.broadcast(lines), ["lang", "shard"])
    cells = stage(recount(docs, shards, groups, sizes, shard_terms, round_bytes), "term-cells")
    totals = {r.gid: r.n for r in cells.select(F.inline("cells")).groupBy("gid").agg(F.sum("n").alias("n")).collect()}
    known = _Groups(groups, sizes, totals)
    terms = shards.select("lang", "first", "keys", "ends").mapInArrow(_listed, "slot long, lang string, term string")
    counted = stage(cells.join(terms, "slot").select("lang", "term", "cells"), "term-counts")

    sums = counted.select("lang", "cells").mapInArrow(_pairs(known), "gid long, other long, value long").groupBy("gid", "other").agg(F.sum("value").alias("value"))
    own, other = names.withColumnRenamed("gid", "_g"), names.select(F.col("gid").alias("_o"), F.col("lang").alias("_lang"), F.col("source").alias("item"))
    pairs = (
        own.join(other, (F.col("lang") == F.col("_lang")) & (F.col("_g") != F.col("_o")))
        .join(sums, (F.col("gid") == F.col("_g")) & (F.col("other") == F.col("_o")), "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    )
    first = (F.desc("value"), F.asc("item"))
    part = F.pmod(F.xxhash64("item"), F.lit(_PARTS))
    peaks = (
        counted.mapInArrow(_peaks(known, top), "gid long, item string, value long")
        .withColumn("_rank", F.row_number().over(Window.partitionBy("gid", part).orderBy(*first)))
        .where(F.col("_rank") <= top)
        .withColumn("_rank", F.row_number().over(Window.partitionBy("gid").orderBy(*first)))
        .where(F.col("_rank") <= top)
    )
    peaks = peaks.join(F.broadcast(names), "gid").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    ranked = Window.partitionBy("lang", "source", "part").orderBy(*first)
    return pairs.unionByName(peaks).withColumn("rank", F.row_number().over(ranked))
