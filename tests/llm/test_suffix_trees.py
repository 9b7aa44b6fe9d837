"""Suffix trees under growing prefixes: removal with groups of any size, and maximal repeats, against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm import repeats


def corpus(seed: int) -> list[tuple[int, str]]:
    """Texts that share passages of several lengths, with common first words and boundaries of every kind."""
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(12)}" for _ in range(rng.choice([13, 14, 20, 40]))] for _ in range(4)]
    passages.append(["the"] * 6 + ["same", "line"] * 5 + ["end"] * 4)
    out = []
    for i in range(40):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [f"u{rng.randrange(6)}" for _ in range(rng.randrange(0, 9))]
            own = rng.choice(passages)
            words += own[rng.choice([0, 0, 1, 3]) : rng.choice([len(own), len(own), len(own) - 2])]
        out.append((i + 1, " ".join(words)))
    return out + [(50, out[3][1]), (51, ""), (52, None), (53, " ".join(passages[0]))]


def plain_removed(rows, window=13):
    first = {}
    split = {i: (t or "").split() for i, t in rows}
    for i, words in split.items():
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, words in split.items():
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


@pytest.mark.parametrize("heavy", [3, 30_000])
def test_groups_of_any_size(spark, heavy):
    rows = corpus(heavy)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeats.without_repeats(docs, heavy=heavy, bin_signs=500).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == plain_removed(rows)


def test_prefixes_grow_until_they_fit(spark):
    words = ["a b c d", "a b c e", "a b d d", "a c d d", "b c d e", "b c d e", "b c d e"]
    suffixes = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "at int, words string")
    parts, grew = repeats.grown_prefixes(suffixes, 2, 4, 1)
    held = {length: sorted(r.words for r in rows.collect()) for length, rows in parts}
    assert held == {1: [], 2: ["a c d d"], 3: ["a b c d", "a b c e", "a b d d"], 4: []}
    length, whole = grew[-1]
    assert length == 4 and [r.words for r in whole.collect()] == ["b c d e"] * 3
    for at, rows in parts:
        prefixes = defaultdict(int)
        for r in rows.collect():
            prefixes[" ".join(r.words.split()[:at])] += 1
        assert all(n <= 2 for n in prefixes.values())
    grouped = repeats.grouped(parts, 3)
    assert grouped.groupBy("_length", F.substring_index("words", " ", 2)).agg(F.count_distinct("_group").alias("n")).where("n > 1 AND _length = 2").isEmpty()


def plain_maximal(rows, least, most):
    """Every passage with its occurrences, kept if the words around it differ or a text ends there."""
    places = defaultdict(list)
    split = {i: (t or "").split() for i, t in rows}
    for i, words in split.items():
        for k in range(len(words)):
            for n in range(least, min(most, len(words) - k) + 1):
                places[tuple(words[k : k + n])].append((i, k))
    out = {}
    for passage, at in places.items():
        if len(at) < 2:
            continue
        before = {split[i][k - 1] if k else None for i, k in at}
        after = {split[i][k + len(passage)] if k + len(passage) < len(split[i]) else None for i, k in at}
        if (len(before) > 1 or None in before) and (len(after) > 1 or None in after or len(passage) == most):
            out[" ".join(passage)] = (len(passage), len(at))
    return out


@pytest.mark.parametrize(("group", "most"), [(30_000, 400), (6, 25)])
def test_maximal_repeats(spark, group, most):
    rows = corpus(5 + group)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.passage: (r.n_words, r.occurrences) for r in repeats.maximal_repeats(docs, 13, most, group, 500).collect()}
    want = plain_maximal(rows, 13, most)
    split = {i: (t or "").split() for i, t in rows}
    within = {p for p in want if len({i for i, w in split.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()}) == 1}
    assert {p: v for p, v in got.items() if p not in within} == {p: v for p, v in want.items() if p not in within} and len(want) > 20
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.maximal_repeats(empty).count() == 0


def test_internal_nodes():
    codes = np.array([[1, 2, 3, -1], [1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 5, -1], [7, -1, -1, -1]])
    nodes = {(depth, tuple(sorted(own.tolist()))) for depth, own in repeats.internal_nodes(codes)}
    assert nodes == {(4, (1, 2)), (3, (0, 1, 2)), (2, (0, 1, 2, 3))}
