"""ROUGE-L and METEOR: order-aware comparison of predictions with references."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tandem.functions.text import words
from tandem.operators.overlap import f1
from tandem.operators.skew import lookup_join

# METEOR weights, and rows of a batch that a worker unfolds at once.
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5
HELD_ROWS = 256


def _common_length(a, b) -> int:
    """Longest common subsequence; a row of the table is one integer's bits."""
    places: dict[str, int] = {}
    for at, token in enumerate(b):
        places[token] = places.get(token, 0) | (1 << at)
    everywhere = (1 << len(b)) - 1
    open_bits = everywhere
    for token in a:
        hits = open_bits & places.get(token, 0)
        open_bits = ((open_bits + hits) | (open_bits - hits)) & everywhere
    return len(b) - open_bits.bit_count()


def _codes(tokens: pa.Array) -> np.ndarray:
    """Equal tokens as equal numbers, null as -1."""
    codes = tokens.dictionary_encode().indices
    return pc.fill_null(codes, -1).to_numpy(zero_copy_only=False)


def _ends(lists: pa.Array) -> np.ndarray:
    """Where each list begins among all elements, and where the last one ends."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(sizes, dtype=np.int64))


@F.arrow_udf(LongType())
def lcs_length(a: pa.Array, b: pa.Array) -> pa.Array:
    """Length of the longest common subsequence of two token arrays; tokens are compared as numbers, few rows at a time."""
    found: list[int] = []
    for at in range(0, len(a), HELD_ROWS):
        x, y = a.slice(at, HELD_ROWS), b.slice(at, HELD_ROWS)
        codes, i, j = _codes(pa.concat_arrays([x.flatten(), y.flatten()])), _ends(x), _ends(y)
        left, right = codes[: i[-1]], codes[i[-1] :]
        for row in range(len(x)):
            found.append(_common_length(left[i[row] : i[row + 1]].tolist(), right[j[row] : j[row + 1]].tolist()))
    return pa.array(found, pa.int64())


def rouge_l_by_sample(texts: DataFrame, key: str = "sample_id") -> DataFrame:
    """ROUGE-L F1 of each sample; rows do not move."""
    return (
        texts.select(key, words(F.col("predicted")).alias("p"), words(F.col("neutral")).alias("r"))
        .select(key, F.size("p").alias("np"), F.size("r").alias("nr"), lcs_length("p", "r").alias("lcs"))
        .select(key, f1(F.col("lcs"), F.col("np"), F.col("nr")).alias("rougeL"))
    )


def meteor_by_sample(
    texts: DataFrame,
    key: str = "sample_id",
    tokens=words,
    classes: Sequence[DataFrame] = (),
) -> DataFrame:
    """METEOR parts of each sample: matches, chunks, lengths and score.

    Words match exactly first: the k-th occurrence from the end on one side with
    the k-th from the end on the other. Each table of ``classes`` (word, class),
    one class per word, then matches leftover words of equal class the same way,
    for instance by stem. Rows of equal keys count as one sample; whether there are
    any is counted first, for without them texts do not move. A sample's tokens stay
    in its row; only the leftover words of a sample with some on both sides are
    unfolded, to find their classes.
    """
    sides = texts.select(key, tokens(F.col("predicted")).alias("_p"), tokens(F.col("neutral")).alias("_r"))
    both = F.col("_p").isNotNull() & F.col("_r").isNotNull()

    def side(words_: Column, predicted: bool) -> Column:
        return F.transform(
            words_,
            lambda word, pos: F.struct(
                F.lit(predicted).alias("predicted"), pos.alias("pos"), word.alias("word")
            ),
        )

    def size(name: str) -> Column:
        return F.when(both, F.size(name)).otherwise(F.lit(0)).cast("bigint").alias("_n" + name[1:])

    listed = F.concat(side(F.col("_p"), True), side(F.col("_r"), False)).alias("_t")
    rows = sides.select(key, size("_p"), size("_r"), listed)
    if not texts.groupBy(key).count().where("count > 1").isEmpty():
        rows = rows.groupBy(key).agg(
            F.sum("_np").alias("_np"), F.sum("_nr").alias("_nr"), F.flatten(F.collect_list("_t")).alias("_t")
        )
    rows = rows.select(key, "_np", "_nr", _paired("word", bool(classes))(F.col("_t")).alias("_found"))
    rows = rows.select(key, "_np", "_nr", "_found.pairs", "_found.free")
    for at, table in enumerate(classes):
        left = rows.select(key, "_np", "_nr", "pairs", F.posexplode_outer("free").alias("_at", "_t"))
        # what is known of the sample goes with the first of its leftover words
        known = F.when(F.coalesce(F.col("_at"), F.lit(0)) == 0, F.struct("_np", "_nr", "pairs"))
        left = left.select(key, known.alias("_known"), "_t.*")
        left = lookup_join(left, table.select("word", "class"), ["word"], spread_by=[key, "predicted", "pos"])
        token = F.when(F.col("pos").isNotNull(), F.struct("predicted", "pos", "word", "class"))
        rows = left.groupBy(key).agg(
            F.element_at(F.collect_list("_known"), 1).alias("_known"), F.collect_list(token).alias("_left")
        )
        found = _paired("class", at + 1 < len(classes))(F.col("_left"))
        rows = rows.select(key, "_known.*", found.alias("_found"))
        pairs = F.array_sort(F.concat("pairs", "_found.pairs"))
        rows = rows.select(key, "_np", "_nr", pairs.alias("pairs"), "_found.free")

    def follows(pair: Column, at: Column) -> Column:
        before = F.get("pairs", at - 1)
        return (pair["pos"] == before["pos"] + 1) & (pair["mate"] == before["mate"] + 1)

    starts = F.filter("pairs", lambda pair, at: ~F.coalesce(follows(pair, at), F.lit(False)))
    parts = rows.select(
        key,
        F.size("pairs").cast("bigint").alias("matches"),
        F.size(starts).cast("bigint").alias("chunks"),
        F.col("_np").alias("predicted_words"),
        F.col("_nr").alias("reference_words"),
    )
    return parts.withColumn("meteor", meteor_value())


def _pairs(codes: list[int], predicted: list[bool], pos: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """((pos, mate) of the tokens that pair up, from the end, in order; places of the others if both sides have some)."""
    order = sorted(range(len(pos)), key=pos.__getitem__)
    waiting: dict[int, list[int]] = {}
    lone: list[int] = []
    for at in order:
        if not predicted[at]:
            (lone if codes[at] < 0 else waiting.setdefault(codes[at], [])).append(at)
    pairs, free = [], []
    for at in reversed(order):
        if predicted[at]:
            mates = waiting.get(codes[at])
            if mates:
                pairs.append((pos[at], pos[mates.pop()]))
            else:
                free.append(at)
    lone += [at for mates in waiting.values() for at in mates]
    return sorted(pairs), free + lone if free and lone else []


def _paired(label: str, keep_free: bool) -> Callable[[Column], Column]:
    """A column function over arrays of tokens: the pairs that agree on the field ``label``, and the tokens left over."""

    @F.arrow_udf("pairs array<struct<pos:int,mate:int>>, free array<struct<predicted:boolean,pos:int,word:string>>")
    def paired(lists: pa.Array) -> pa.Array:
        pos, mates, free_words, pair_ends, free_ends = [], [], [], [0], [0]
        for first in range(0, len(lists), HELD_ROWS):
            some = lists.slice(first, HELD_ROWS)
            tokens, ends = some.flatten(), _ends(some)
            codes = _codes(tokens.field(label))
            sides = tokens.field("predicted").to_numpy(zero_copy_only=False)
            places = tokens.field("pos").to_numpy(zero_copy_only=False)
            left: list[int] = []
            for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
                pairs, free = _pairs(codes[start:end].tolist(), sides[start:end].tolist(), places[start:end].tolist())
                pos += [p for p, _ in pairs]
                mates += [m for _, m in pairs]
                pair_ends.append(len(pos))
                if keep_free:
                    left += [start + at for at in free]
                free_ends.append(free_ends[-1] + (len(free) if keep_free else 0))
            free_words.append(tokens.take(pa.array(left, pa.int64())))
        both = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(mates, pa.int32())], ["pos", "mate"])
        names = ["predicted", "pos", "word"]
        kinds = [pa.bool_(), pa.int32(), pa.string()]
        columns = [
            pa.concat_arrays([pa.array([], kind), *(words_.field(name).cast(kind) for words_ in free_words)])
            for name, kind in zip(names, kinds)
        ]
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array(pair_ends, pa.int32()), both),
                pa.ListArray.from_arrays(pa.array(free_ends, pa.int32()), pa.StructArray.from_arrays(columns, names)),
            ],
            ["pairs", "free"],
        )

    return paired


def meteor_value() -> Column:
    """Score from matches, chunks and both lengths; 0 where nothing matches."""
    precision = F.col("matches") / F.col("predicted_words")
    recall = F.col("matches") / F.col("reference_words")
    mean = precision * recall / (ALPHA * precision + (1 - ALPHA) * recall)
    penalty = GAMMA * F.pow(F.col("chunks") / F.col("matches"), F.lit(BETA))
    return F.when(F.col("matches") > 0, (1 - penalty) * mean).otherwise(0.0)
