"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are added up by the set of sources they belong to. Between these few
patterns and the sources runs a flow: a pattern gives its words once at no cost
and again at a rising cost, a source takes words up to its target. The cheapest
flow of greatest size says how many words of each pattern to take, repeats
counted; a seeded choice of documents then fills these amounts.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.tables import bounded_join, unused
from tandem.llm.words import WORD, text_or_empty
from tandem.session import stage

#: Fixed values of the mix: weights by place of the source, share of all words, times a word may be used.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
SEED = 17
#: The flow is solved on the driver; beyond so many patterns the membership is not a mix of sources.
MOST_PATTERNS = 20_000
_CELLS = 1 << 16
_PLANNED = pa.schema(
    [("_names", pa.list_(pa.string())), ("source_size", pa.int64()), ("target", pa.float64()), ("_passes", pa.int64()), ("_rest", pa.int64())]
)


def word_count(text: Column | str) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")


def capped_targets(
    sizes: Sequence[int], weights: Sequence[float], total: float, times: float
) -> list[float]:
    """Shares of ``total`` by weight, none above ``times`` its size, the excess shared out anew."""
    targets, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), total
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > times * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = weights[i] * unit
            break
        for i in full:
            targets[i] = float(times * sizes[i])
            rest -= targets[i]
        open_ = [i for i in open_ if i not in full]
    return targets


def min_cost_flow(
    sizes: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], repeats: int
) -> list[int]:
    """Words taken of each pattern: the largest flow to the quotas, at least cost.

    A pattern's k-th pass over its words costs k - 1 a word. Flow runs along
    cheapest augmenting paths; an arc may be taken back.
    """
    n, m = len(sizes), len(quotas)
    start, end = n + m, n + m + 1
    head: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n + m + 2)]
    passes: list[list[int]] = [[] for _ in range(n)]

    def arc(a: int, b: int, capacity: int, price: int) -> None:
        for node, to, free, c in ((a, b, capacity, price), (b, a, 0, -price)):
            arcs[node].append(len(head))
            head.append(to)
            room.append(free)
            cost.append(c)

    for p, size in enumerate(sizes):
        for k in range(repeats):
            passes[p].append(len(head))
            arc(start, p, size, k)
        for s in members[p]:
            arc(p, n + s, size * repeats, 0)
    for s, quota in enumerate(quotas):
        arc(n + s, end, quota, 0)
    while True:
        far = [None] * (n + m + 2)
        via = [-1] * (n + m + 2)
        far[start] = 0
        queue = [start]
        while queue:
            again: dict[int, None] = {}
            for node in queue:
                for e in arcs[node]:
                    to = head[e]
                    if room[e] and (far[to] is None or far[node] + cost[e] < far[to]):
                        far[to], via[to] = far[node] + cost[e], e
                        again[to] = None
            queue = list(again)
        if far[end] is None:
            break
        path, node = [], end
        while node != start:
            path.append(via[node])
            node = head[via[node] ^ 1]
        moved = min(room[e] for e in path)
        for e in path:
            room[e] -= moved
            room[e ^ 1] += moved
    return [sum(room[e ^ 1] for e in own) for own in passes]


def mixed_documents(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the staged result of ``mix`` takes them, with all their own columns."""
    id_, hash_, copies, copy = unused(docs, "_mix_id", "_mix_hash", "_mix_copies", "_mix_copy")
    taken = chosen.where("copies > 0").select("doc_id", "text_hash", "copies").distinct().toDF(id_, hash_, copies)
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_)) & (F.xxhash64(text_or_empty("text")) == F.col(hash_))
    listed = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))
    return bounded_join(docs, taken, same, "inner").select(*docs.columns, listed.alias(copy)).drop(copy)


def seeded(seed: int) -> Column:
    """A document's place in the seeded order, the same on every run."""
    return F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("_text_hash"))


def mix(
    docs: DataFrame,
    membership: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """How often each document goes into a mix of its sources.

    Reads ``doc_id``, ``text`` and ``source`` (or ``membership``, an array of
    source names, null names allowed); ignores other columns. Sources in
    code-point order, null last, weigh ``weights`` over and over; they share
    ``share`` of all words, each at most ``repeats`` times its own. A document's
    size is its number of words, 0 for null. Returns per row doc_id, size,
    source_size and target (those of its first source), copies (0 to
    ``repeats``), taken (copies times size) and text_hash, which with the id names the row. Rows equal in id and text get
    equal copies; a document without words is taken 0 times; an empty table gives
    an empty result.
    """
    names = F.array("source") if membership is None else F.coalesce(membership, F.expr("cast(array() as array<string>)"))
    slim = stage(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            word_count("text").alias("size"),
            F.xxhash64(text_or_empty("text")).alias("_text_hash"),
            F.array_sort(F.array_distinct(names)).alias("_names"),
        ).withColumn("_key", seeded(seed)),
        "mix-sizes",
    )
    totals = slim.groupBy("_names").agg(F.sum("size").alias("words")).limit(MOST_PATTERNS + 1).collect()
    if len(totals) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources")
    patterns = [(tuple(r["_names"]), int(r["words"])) for r in totals]
    sources = sorted({s for names, _ in patterns for s in names}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(sources)}
    sizes = [sum(w for names, w in patterns if s in names) for s in sources]
    every = sum(w for _, w in patterns)
    targets = capped_targets(
        sizes, [weights[i % len(weights)] for i in range(len(sources))], share * every, repeats
    )
    taken = min_cost_flow(
        [w for _, w in patterns], [[place[s] for s in names] for names, _ in patterns],
        [round(t) for t in targets], repeats,
    )
    plan = []
    for (names, words), flow in zip(patterns, taken, strict=True):
        first = min((place[s] for s in names), default=None)
        passes, rest = divmod(flow, words) if words else (0, 0)
        plan.append(
            (list(names), sizes[first] if names else 0, targets[first] if names else 0.0, passes, rest)
        )
    spark = docs.sparkSession
    # from Arrow: rows of a Python list would go through Python workers of their own, which stay in the executors
    planned = spark.createDataFrame(
        pa.Table.from_pylist([dict(zip(_PLANNED.names, row, strict=True)) for row in plan], _PLANNED)
    )
    # at most MOST_PATTERNS rows
    joined = slim.join(F.broadcast(planned), "_names")
    cell = F.pmod(F.shiftrightunsigned("_key", 13), F.lit(_CELLS))
    return _chosen(joined.withColumn("_cell", cell))


def _chosen(rows: DataFrame) -> DataFrame:
    """Add copies and taken: whole passes, and of the rest the documents first in seeded order.

    Sizes are summed by cell of the seeded order; only the cell in which a
    pattern's rest runs out, a 65,536th part, is ordered document by document.
    """
    cells = rows.groupBy("_names", "_rest", "_cell").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("_names").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        cells.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
        .where("_before <= _rest AND _rest < _before + _words")
        .select("_names", F.col("_cell").alias("_last"), "_before")
    )
    cut = rows.join(F.broadcast(last), "_names", "left")
    # a range frame gives equal rows, which have equal keys, one sum
    up_to = Window.partitionBy("_names").orderBy("_key")
    ran = F.sum("size").over(up_to.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    inside = cut.where("_cell = _last").withColumn("_ran", F.col("_before") + ran)
    inside = inside.withColumn(
        "_extra", (F.col("_ran") - F.col("size") / 2 <= F.col("_rest")).cast("bigint")
    )
    outside = cut.where("_last IS NULL OR _cell <> _last").withColumn(
        "_extra", F.coalesce(F.col("_cell") < F.col("_last"), F.lit(False)).cast("bigint")
    )
    columns = ["doc_id", "_text_hash", "size", "source_size", "target", "_passes", "_extra"]
    copies = F.when(F.col("size") > 0, F.col("_passes") + F.col("_extra")).otherwise(F.lit(0))
    return (
        inside.select(*columns)
        .unionByName(outside.select(*columns))
        .select(
            "doc_id", "size", "source_size", "target", copies.alias("copies"),
            (copies * F.col("size")).alias("taken"), F.col("_text_hash").alias("text_hash"),
        )
    )
