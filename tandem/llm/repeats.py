"""Repeated passages by prefix-partitioned suffix trees over words.

A passage of 13 words is a node of depth 13 in the tree of all suffixes: it is
repeated if the node has leaves in two documents. The tree is never whole:

1. Every window of 13 words has an anchor, its five-word run of least hash, the
   same wherever the window stands. Anchors met in one document only cannot lie
   in a repeat; they are sorted out by hash, in bins of bounded size.
2. Around the other anchors the documents send contexts, the words that the
   anchor's windows cover. Equal contexts are leaves of the same nodes and become
   one, with their least document. A context that is alone with its anchor shares
   no window with another, so its nodes are known.
3. The windows of the other contexts are suffixes, cut to 13 words, and are split
   into groups of bounded size. Contexts first go by the prefix of the suffix that starts at
   their anchor, its five words, which moves their shared words once. Where that
   prefix holds more windows than a group may, these go by their own first
   words, and a prefix with too many suffixes grows by a word, again and again.
   A group is sorted as one suffix array with the lengths of common prefixes, which is
   the subtree under its prefixes, and its nodes of depth 13 get their least document.
   A prefix that has grown to the whole window is a node by itself.
4. The least documents go back to the contexts, and from there to their leaves.

Words are compared, not hashes; equal contexts are found by 128-bit hashes, and
whole copies of a text, settled before, by SHA-256. ``maximal_repeats`` reads the
same subtrees for their deep internal nodes of any depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.minhash import mixed
from tandem.llm.tables import bounded_join
from tandem.llm.words import PLAIN, WordHashes, cut, slices, text_bytes, text_or_empty
from tandem.session import stage

WINDOW, ANCHOR = 13, 5
#: Signs of text a bin of anchors stands for, suffixes of a group, and words of the shortest prefix.
_BIN_SIGNS, _GROUP, _SHORTEST = 6_000_000, 30_000, 2
#: Bytes of a side that may be sent to every worker.
_SENT = 32 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_HASHES = WordHashes()


def _anchors(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each five-word run, place of the anchor of each window)."""
    codes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(codes) - ANCHOR + 1
    rolled = np.full(n, np.uint64(ANCHOR))
    for k in range(ANCHOR):
        rolled = rolled * _ODD + codes[k : n + k]
    hashes = mixed(rolled)
    wide = np.lib.stride_tricks.sliding_window_view(hashes, window - ANCHOR + 1)
    return hashes, wide.argmin(1) + np.arange(len(wide))


def _anchor_bins(bins: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, docs, places = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch), strict=True):
                words = text.split()
                if len(words) >= window:
                    own, at = _anchors(words, window)
                    at = np.unique(at)
                    own, first = np.unique(own[at], return_index=True)
                    hashes.append(own)
                    docs.append(np.full(len(own), doc_id, np.int64))
                    places.append(at[first].astype(np.int32))
            if not hashes:
                continue
            h, d, p = np.concatenate(hashes), np.concatenate(docs), np.concatenate(places)
            order = np.lexsort((d, h))
            h, d, p = h[order], d[order], p[order]
            # an anchor that two documents of this batch share is repeated for certain: one of them goes on to
            # the bin, marked; the others need no further look
            new = np.append(True, h[1:] != h[:-1])
            first_of = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            known = d != d[first_of]
            shared = np.zeros(len(h), bool)
            shared[first_of[known]] = True
            again = ~new & ~known  # rows that repeat an id and its text
            bin_of = (h >> np.uint64(20)) % np.uint64(bins)
            for b in np.unique(bin_of):
                mine = np.flatnonzero(bin_of == b)
                sent = mine[~known[mine] & ~again[mine]]
                rest = mine[known[mine]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "bin": [int(b)],
                        "hashes": [h[sent].tobytes()],
                        "docs": [d[sent].tobytes()],
                        "places": [p[sent].tobytes()],
                        "shared": [shared[sent].tobytes()],
                        "more_docs": [d[rest].tobytes()],
                        "more_places": [p[rest].tobytes()],
                    },
                    schema=pa.schema([("bin", pa.int64())] + [(c, pa.binary()) for c in ("hashes", "docs", "places", "shared", "more_docs", "more_places")]),
                )

    return run


def _repeated(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    def joined(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(group[name]), kind)

    h, d, p = joined("hashes", np.uint64), joined("docs", np.int64), joined("places", np.int32)
    shared = joined("shared", bool)
    order = np.lexsort((d, h))
    h, d, p, shared = h[order], d[order], p[order], shared[order]
    docs, places = [joined("more_docs", np.int64)], [joined("more_places", np.int32)]
    if len(h):
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        sizes = np.diff(np.append(starts, len(h)))
        many = np.maximum.reduceat(d, starts) != np.minimum.reduceat(d, starts)
        keep = np.repeat(many | np.logical_or.reduceat(shared, starts), sizes)
        docs.append(d[keep])
        places.append(p[keep])
    return pd.DataFrame({"doc_id": np.concatenate(docs), "place": np.concatenate(places)})


def _contexts(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            anchors, starts, sizes, rows, names, held = [], [], [], [], [], []
            texts = text_bytes(batch)
            for row, (text, places) in enumerate(zip(texts, batch.column(3).to_pylist(), strict=True)):
                words = text.split()
                if len(words) < window:
                    continue
                hashes, at = _anchors(words, window)
                shared = np.zeros(len(hashes), bool)
                shared[[x for x in places if x < len(hashes)]] = True
                cuts = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])), len(at))
                first, end = cuts[:-1], cuts[1:]
                # equal anchors have equal hashes, wherever they stand
                wanted = shared[at[first]] | np.isin(hashes[at[first]], hashes[shared])
                first, end = first[wanted], end[wanted]
                anchors.append(hashes[at[first]].view(np.int64))
                starts.append(first)
                sizes.append(end - first)
                rows.append(np.full(len(first), row))
                own = [b" ".join(words[s:e]) for s, e in zip(first.tolist(), (end + window - 1).tolist(), strict=True)]
                held += own
                names += map(xxhash.xxh3_128_digest, own)
            if held:
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(anchors)),
                        batch.column(0).take(row),
                        batch.column(2).take(row),
                        pa.array(np.concatenate(starts).astype(np.int32)),
                        pa.array(np.concatenate(sizes).astype(np.int32)),
                        pa.array(names, pa.binary()),
                        pa.array(held, pa.binary()),
                    ],
                    ["anchor", "doc_id", "_key", "start", "windows", "context", "words"],
                )

    return run


def _windows_of(found: pa.Array, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in it, first word among all) of every window of the rows' words."""
    windows = counts - window + 1
    row = np.repeat(np.arange(len(counts)), windows)
    at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    return row, at, (np.cumsum(counts) - counts)[row] + at


def _suffixes(window: int):
    """(context, at, least, words): each window of distinct contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            found, counts = cut(batch.column(2), PLAIN)
            ends = np.frombuffer(found.buffers()[1], np.int32)
            row, at, first = _windows_of(found, counts, window)
            # the words of a window lie side by side; a space goes before each word but the first
            spaced = np.insert(np.frombuffer(found.buffers()[2], np.uint8), ends[1:-1], 32)
            total = ends[first + window] - ends[first] + window - 1
            stops = np.append(0, np.cumsum(total))
            own = spaced[np.repeat(ends[first] + first - stops[:-1], total) + np.arange(stops[-1])]
            words = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(own)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), batch.column(1).take(pa.array(row)), words.cast(pa.string())],
                ["context", "at", "least", "words"],
            )

    return run


def subtree(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): a suffix array of equally long suffixes and each one's common words with its forerunner."""
    order = np.lexsort(suffixes.T[::-1])
    ranked = suffixes[order]
    common = np.zeros(len(order), np.int32)
    if len(order) > 1:
        equal = ranked[1:] == ranked[:-1]
        common[1:] = np.where(equal.all(1), suffixes.shape[1], (~equal).argmax(1))
    return order, common


def deep_nodes(suffixes: np.ndarray, depth: int) -> np.ndarray:
    """The node of that depth each suffix hangs from, numbered."""
    order, common = subtree(suffixes)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def _coded(words: pa.ChunkedArray, depth: int) -> np.ndarray:
    """One row of word numbers per suffix, -1 past its end."""
    texts = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    found, counts = cut(texts, PLAIN)
    codes = found.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    out = np.full((len(counts), depth), -1, np.int32)
    row = np.repeat(np.arange(len(counts)), counts)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = codes
    return out


def _leasts(window: int):
    """The least document of the node of depth ``window`` over each suffix of a group."""

    def run(group: pa.Table) -> pa.Table:
        node = deep_nodes(_coded(group["words"], window), window)
        own = group["least"].to_numpy()
        least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, own)
        return pa.table({"context": group["context"], "at": group["at"], "least": pa.array(least[node])})

    return run


def _context_leasts(window: int):
    """The least documents of the windows of a group of contexts, as one array each."""

    def run(group: pa.Table) -> pa.Table:
        found, counts = cut(group["words"].combine_chunks(), PLAIN)
        codes = found.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)
        row, _, first = _windows_of(found, counts, window)
        node = deep_nodes(codes[first[:, None] + np.arange(window)], window)
        own = group["least"].to_numpy()[row]
        least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, own)
        ends = np.append(0, np.cumsum(counts - window + 1)).astype(np.int32)
        return pa.table({"context": group["context"], "leasts": pa.ListArray.from_arrays(pa.array(ends), pa.array(least[node]))})

    return run


def _prefix(length: int) -> Column:
    return F.substring_index("words", " ", length)


def grown_prefixes(
    suffixes: DataFrame, group: int, longest: int, shortest: int = _SHORTEST
) -> tuple[list[tuple[int, DataFrame]], list[tuple[int, DataFrame]]]:
    """Split suffixes (``words``, ...) by prefixes that hold at most ``group`` of them.

    Returns (prefix length, its suffixes) by length, and (length, the suffixes
    whose prefix of that length holds more). Of these the longer ones go on to the
    next length; the others, and all at ``longest``, are equal under their prefix. Each level counts what is left by prefix, combined before it moves, and writes
    only the part that must grow.
    """
    parts, grew, open_ = [], [], suffixes
    for length in range(min(shortest, longest), longest + 1):
        named = open_.withColumn("_prefix", F.xxhash64(_prefix(length)))
        many = named.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group).select("_prefix")
        many = stage(many, "repeat-prefixes")
        if many.isEmpty():
            return [*parts, (length, open_)], grew
        parts.append((length, bounded_join(named, many, "_prefix", "left_anti").drop("_prefix")))
        held = stage(bounded_join(named, many, "_prefix", "left_semi").drop("_prefix"), "repeat-open")
        grew.append((length, held))
        open_ = held.where(F.length("words") > F.length(_prefix(length)))
        if length == longest or open_.isEmpty():
            break
    return parts, grew


def grouped(parts: list[tuple[int, DataFrame]], groups: int) -> DataFrame:
    """The suffixes of all lengths with ``_length`` and ``_group``: prefixes put together by hash."""
    out = None
    for length, rows in parts:
        group = F.pmod(F.xxhash64(F.lit(length), _prefix(length)), F.lit(groups))
        rows = rows.withColumn("_length", F.lit(length)).withColumn("_group", group)
        out = rows if out is None else out.unionByName(rows)
    return out


def _sent(df: DataFrame, size: Column) -> bool:
    """Whether a staged side's counted bytes are few enough to be sent to every worker."""
    return (df.agg(F.sum(size)).first()[0] or 0) <= _SENT


def context_leasts(contexts: DataFrame, window: int, group: int) -> DataFrame:
    """(context, least, leasts): the least document of every window of each distinct context.

    ``least`` stands for all windows where ``leasts`` is null.
    """
    distinct = stage(
        contexts.groupBy("anchor", "context", "windows", "words").agg(F.min("doc_id").alias("least")), "repeat-distinct"
    )
    held = stage(
        distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"), F.sum("windows").alias("_windows")).where("_n > 1").drop("_n"),
        "repeat-anchors-shared",
    )
    total = held.agg(F.sum("_windows")).first()[0] or 0
    joined = distinct.join(held.hint("merge"), "anchor", "left")
    single = joined.where("_windows IS NULL").select("context", "least", F.lit(None).cast("array<bigint>").alias("leasts"))
    none = F.lit(None).cast("bigint").alias("least")
    by_anchor = F.pmod(F.xxhash64("anchor"), F.lit(max(1, total // group)))
    fit = joined.where(F.col("_windows") <= group).groupBy(by_anchor.alias("_group"))
    fit = fit.applyInArrow(_context_leasts(window), "context binary, leasts array<long>")
    answers = single.unionByName(fit.select("context", none, "leasts"))

    many = stage(joined.where(F.col("_windows") > group).select("context", "least", "words", "windows"), "repeat-rest")
    rest = many.agg(F.sum("windows")).first()[0] or 0
    if rest:
        suffixes = many.select("context", "least", "words").mapInArrow(_suffixes(window), "context binary, at int, least long, words string")
        parts, grew = grown_prefixes(suffixes, group, window)
        found = grouped(parts, max(1, rest // group)).groupBy("_group").applyInArrow(_leasts(window), "context binary, at int, least long")
        if grew and grew[-1][0] == window:
            # a whole window is a node by itself, one grouped row
            whole = grew[-1][1]
            least = whole.groupBy("words").agg(F.min("least").alias("_least"))
            found = found.unionByName(whole.join(least, "words").select("context", "at", F.col("_least").alias("least")))
        listed = F.sort_array(F.collect_list(F.struct("at", "least"))).getField("least")  # a context's windows
        answers = answers.unionByName(found.groupBy("context").agg(listed.alias("leasts")).select("context", none, "leasts"))
    return answers


def _placed(docs: DataFrame, signs: int, window: int, bin_signs: int) -> DataFrame:
    """(doc_id, places): the places of anchors that two documents share."""
    bins = max(1, signs // bin_signs)
    return stage(
        docs.select("doc_id", "text")
        .mapInArrow(
            _anchor_bins(bins, window),
            "bin long, hashes binary, docs binary, places binary, shared binary, more_docs binary, more_places binary",
        )
        .groupBy("bin")
        .applyInPandas(_repeated, "doc_id long, place int")
        .groupBy("doc_id")
        .agg(F.collect_list("place").alias("places")),  # at most a document's words
        "repeat-anchors",
    )


def repeated_windows(docs: DataFrame, signs: int, window: int = WINDOW, group: int = _GROUP, bin_signs: int = _BIN_SIGNS) -> DataFrame:
    """(doc_id, _key, starts): windows, by first word, that also start in a document with a smaller doc_id.

    ``docs`` has doc_id, text and _key, which tells rows of one id apart;
    ``signs`` is the length of all texts, from which the bins are counted.
    """
    places = _placed(docs, signs, window, bin_signs)
    few = _sent(places, 16 + 4 * F.size("places"))
    held = docs.select("doc_id", "text", "_key").join(F.broadcast(places) if few else places.hint("merge"), "doc_id")
    contexts = stage(
        held.select("doc_id", "text", "_key", "places").mapInArrow(
            _contexts(window), "anchor long, doc_id long, _key long, start int, windows int, context binary, words binary"
        ),
        "repeat-contexts",
    )
    leasts = context_leasts(contexts, window, group)
    leaves = contexts.select("context", "doc_id", "_key", "start", "windows")
    known = leaves.join(leasts.hint("merge"), "context")
    later = known.where("(leasts IS NULL AND doc_id > least) OR (leasts IS NOT NULL AND doc_id > array_min(leasts))")
    every = F.sequence(F.lit(0), F.col("windows") - 1)
    hit = F.when(F.col("leasts").isNull(), every).otherwise(F.filter(every, lambda j: F.col("doc_id") > F.get("leasts", j)))
    starts = F.transform(hit, lambda j: F.col("start") + j)
    return later.select("doc_id", "_key", starts.alias("starts")).groupBy("doc_id", "_key").agg(
        F.sort_array(F.flatten(F.collect_list("starts"))).alias("starts")  # at most a document's words
    )


def _occurrences(window: int, depth: int):
    """(words, before, opens): the suffixes that start at a window with a shared anchor, cut to ``depth`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows: list[tuple] = []
            for text, places in zip(text_bytes(batch), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                if len(words) < window:
                    continue
                hashes, at = _anchors(words, window)
                wanted = np.isin(hashes[at], hashes[[x for x in places if x < len(hashes)]])
                for k in np.flatnonzero(wanted).tolist():
                    rows.append((b" ".join(words[k : k + depth]).decode(), words[k - 1].decode() if k else "", k == 0))
            if rows:
                kinds = (pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["words", "before", "opens"]
                )

    return run


def internal_nodes(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(depth, the suffixes below) of every internal node of the tree of suffixes, rows padded with -1."""
    order = np.lexsort(codes.T[::-1])
    ranked = codes[order]
    common = np.zeros(len(order) + 1, np.int64)
    if len(order) > 1:
        same = (ranked[1:] == ranked[:-1]) & (ranked[1:] >= 0)
        common[1:-1] = np.where(same.all(1), codes.shape[1], (~same).argmax(1))
    open_: list[tuple[int, int]] = []  # (depth, first rank) of the nodes above the present suffix
    for rank, depth in enumerate(common.tolist()):
        begin = rank - 1
        while open_ and open_[-1][0] > depth:
            deep, begin = open_.pop()
            yield deep, order[begin:rank]
        if depth and (not open_ or open_[-1][0] < depth):
            open_.append((depth, begin))


_REPEAT = "passage string, n_words long, occurrences long"


def _maximal(least: int, depth: int):
    """The nodes of a group that are as deep as its prefixes and differ in the word before."""

    def run(group: pa.Table) -> pa.Table:
        texts, length = group["words"].combine_chunks(), group["_length"].to_numpy()
        before = group["before"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        opens = group["opens"].combine_chunks().to_numpy(zero_copy_only=False)
        out: list[tuple[str, int, int]] = []
        for deep, own in internal_nodes(_coded(texts, depth)):
            if deep >= max(least, length[own[0]]) and (opens[own].any() or (before[own] != before[own[0]]).any()):
                out.append((" ".join(texts[int(own[0])].as_py().split(" ")[:deep]), deep, len(own)))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["passage", "n_words", "occurrences"])

    return run


def maximal_repeats(
    docs: DataFrame, least: int = WINDOW, most: int = 64, group: int = _GROUP, bin_signs: int = _BIN_SIGNS
) -> DataFrame:
    """(passage, n_words, occurrences): passages of ``least`` words or more that occur again and cannot be extended.

    A passage is maximal if two of its occurrences differ in the word before, or
    one opens its text, and likewise after. Only passages with an anchor that two documents share are
    looked for, so repeats within a single document alone are not given. A longer repeat than
    ``most`` words is given as its first ``most`` words. Reads ``doc_id`` and ``text``; rows that
    share an id count as one document for the anchors. An empty table gives an empty result.
    """
    if least < 2 * ANCHOR - 1:
        raise ValueError(f"a passage needs at least {2 * ANCHOR - 1} words")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text")).where("doc_id IS NOT NULL")
    signs = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    places = _placed(texts, signs, least, bin_signs)
    few = _sent(places, 16 + 4 * F.size("places"))
    held = texts.join(F.broadcast(places) if few else places.hint("merge"), "doc_id")
    found = stage(held.mapInArrow(_occurrences(least, most), "words string, before string, opens boolean"), "repeat-suffixes")
    parts, grew = grown_prefixes(found, group, most)
    out = grouped(parts, max(1, found.count() // group)).groupBy("_group").applyInArrow(_maximal(least, most), _REPEAT)
    for length, rows in grew:
        if length >= least:
            # a node on the way down to the groups: its next words and the words before it, in one grouped row
            after = F.substring_index(F.substr("words", F.length(_prefix(length)) + 2), " ", 1)
            nodes = rows.groupBy(_prefix(length).alias("passage")).agg(
                F.count(F.lit(1)).alias("occurrences"),
                *(f(c).alias(n) for n, f, c in (("_a", F.min, after), ("_b", F.max, after), ("_c", F.min, F.col("before")), ("_d", F.max, F.col("before")))),
                F.bool_or("opens").alias("_opens"),
            )
            nodes = nodes.where("(_a < _b OR _a = '') AND (_opens OR _c < _d) AND occurrences > 1")
            out = out.unionByName(nodes.select("passage", F.lit(length).cast("bigint").alias("n_words"), "occurrences"))
    return out


def _kept(window: int, copies: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            totals, removed, kept = [], [], []
            starts = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for text, own in zip(text_bytes(batch), starts, strict=True):
                words = text.split()
                totals.append(len(words))
                if copies and len(words) >= window:
                    words = []
                elif own:
                    mark = np.zeros(len(words) + 1, np.int32)
                    np.add.at(mark, own, 1)
                    np.add.at(mark, np.array(own) + window, -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(totals[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, heavy: int = _GROUP, bin_signs: int = _BIN_SIGNS) -> DataFrame:
    """Each document without the words of windows that start in a document with a smaller doc_id.

    A prefix with more than ``heavy`` suffixes grows. Reads ``doc_id`` and ``text``
    (null: empty), ignores other columns. Windows are ``window`` (at least 9) consecutive words, compared as they are, and judged on the input.
    Returns per row doc_id, n_words, n_removed and kept_text, the kept words
    joined by one space. Rows of one id never remove one another's words; a row
    without an id loses none and removes none. Empty tables give an empty result.
    """
    if window < 2 * ANCHOR - 1:
        raise ValueError(f"a window needs at least {2 * ANCHOR - 1} words")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))
    named = stage(
        texts.where("doc_id IS NOT NULL").select(
            "doc_id", F.length("text").alias("_signs"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("_name")
        ),
        "repeat-texts",
    )
    # of equal texts only the least document goes on: its copies are removed whole and remove nothing more
    first = named.groupBy("_name").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    copies = stage(
        named.join(first, "_name").where("doc_id > _first").select("doc_id", F.xxhash64("_name").alias("_key")).distinct(),
        "repeat-copies",
    )
    keyed = texts.withColumn("_key", F.xxhash64(F.unhex(F.sha2(F.col("text").cast("binary"), 256))))
    single = bounded_join(keyed, copies, ["doc_id", "_key"], "left_anti")
    signs = named.agg(F.sum("_signs")).first()[0] or 0
    covered = stage(repeated_windows(single.where("doc_id IS NOT NULL"), signs, window, heavy, bin_signs), "repeat-covered")
    ids = covered.select("doc_id", "_key")
    row = "doc_id long, n_words long, n_removed long, kept_text string"
    touched = bounded_join(single, ids, ["doc_id", "_key"], "left_semi").join(covered, ["doc_id", "_key"])
    untouched = bounded_join(single, ids, ["doc_id", "_key"], "left_anti")
    whole = bounded_join(keyed, copies, ["doc_id", "_key"], "left_semi")
    return (
        untouched.select("doc_id", "text").mapInArrow(_kept(window, False), row)
        .unionByName(touched.select("doc_id", "text", "starts").mapInArrow(_kept(window, False), row))
        .unionByName(whole.select("doc_id", "text").mapInArrow(_kept(window, True), row))
    )
