"""Corpus metrics against plain implementations and known properties."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import classify
from tandem.operators.overlap import bleu, bleu_statistics, overlap_by_sample, rouge_n
from tandem.operators.sequences import _common_length, lcs_length, meteor_by_sample, rouge_l_by_sample
from tandem.operators.similarity import _greedy_f1, greedy_match_by_sample, similarity_by_sample
from tandem.plans.evaluate import METRICS, evaluate, score_samples


def texts(spark, rows):
    schema = "sample_id long, predicted string, neutral string"
    return spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(rows)], schema)


def bleu_of(spark, rows):
    return bleu(overlap_by_sample(texts(spark, rows))).first().bleu


def plain_bleu(rows):
    matched, total = Counter(), Counter()
    plen = rlen = 0
    for p, r in rows:
        p, r = p.split(), r.split()
        plen, rlen = plen + len(p), rlen + len(r)
        for n in range(1, 5):
            a = Counter(tuple(p[i : i + n]) for i in range(len(p) - n + 1))
            b = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
            matched[n] += sum((a & b).values())
            total[n] += sum(a.values())
    if min(matched[n] for n in range(1, 5)) == 0:
        return 0.0
    logs = sum(math.log(matched[n] / total[n]) for n in range(1, 5)) / 4
    return math.exp(logs) * (1.0 if plen > rlen else math.exp(1 - rlen / plen))


def noise(seed, rows=12, size=40, words=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    made = []
    for _ in range(rows):
        reference = text(rng.randint(5, size))
        kept = [w for w in reference.split() if rng.random() > 0.1]
        made.append((" ".join(kept), reference))
    return made


def test_bleu_bounds(spark):
    same = "the quick brown fox jumps over it"
    assert bleu_of(spark, [(same, same)]) == pytest.approx(1.0)
    assert bleu_of(spark, [("a b c d e", "v w x y z")]) == 0.0
    assert bleu_of(spark, [("a b c", "a b c")]) == 0.0  # no 4-gram at all
    assert bleu_of(spark, [("", "a b c d")]) == 0.0


@pytest.mark.parametrize("seed", [1, 2])
def test_bleu_equals_plain(spark, seed):
    rows = noise(seed)
    assert bleu_of(spark, rows) == pytest.approx(plain_bleu(rows))
    longer = [(r + " w1 w2", p) for p, r in rows]
    assert bleu_of(spark, longer) == pytest.approx(plain_bleu(longer))


def test_bleu_statistics(spark):
    got = bleu_statistics(overlap_by_sample(texts(spark, [("a b a", "a b b")]))).collect()
    assert [(r.n, r.matched, r.total, r.reference) for r in sorted(got)] == [
        (1, 2, 3, 3), (2, 1, 2, 2), (3, 0, 1, 1), (4, 0, 0, 0)
    ]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_result_does_not_depend_on_partitions(spark, parts):
    rows = noise(3)
    spread = texts(spark, rows).repartition(parts)
    assert bleu(overlap_by_sample(spread)).first().bleu == pytest.approx(plain_bleu(rows))


def test_rouge(spark):
    rows = [("The cat!", "the cat sat"), ("", "x"), ("same words", "Same words")]
    got = rouge_n(overlap_by_sample(texts(spark, rows))).first()
    assert got.rouge1 == pytest.approx((2 * 2 / 5 + 0 + 1) / 3)
    assert got.rouge2 == pytest.approx((2 * 1 / 3 + 0 + 1) / 3)
    by_sample = rouge_l_by_sample(texts(spark, rows + [("a x b y c", "a b c")])).collect()
    assert {r.sample_id: round(r.rougeL, 6) for r in by_sample} == {0: 0.8, 1: 0, 2: 1, 3: 0.75}


def test_common_length_equals_table():
    rng = random.Random(5)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                row[j + 1], before = (
                    (before + 1, row[j + 1]) if x == y else (max(row[j], row[j + 1]), row[j + 1])
                )
        assert _common_length(a, b) == row[-1]


def plain_meteor(p, r, classes=()):
    p, r = list(enumerate(p.split())), list(enumerate(r.split()))
    np_, nr, matches = len(p), len(r), []
    for same in [lambda w: w, *(c.get for c in classes)]:
        for i in range(len(p) - 1, -1, -1):
            for j in range(len(r) - 1, -1, -1):
                if same(p[i][1]) is not None and same(p[i][1]) == same(r[j][1]):
                    matches.append((p.pop(i)[0], r.pop(j)[0]))
                    break
    matches.sort()
    if not matches:
        return 0, 0, 0.0
    chunks = 1 + sum(
        not (b[0] == a[0] + 1 and b[1] == a[1] + 1) for a, b in zip(matches, matches[1:])
    )
    m = len(matches)
    precision, recall = m / np_, m / nr
    mean = precision * recall / (0.9 * precision + 0.1 * recall)
    return m, chunks, (1 - 0.5 * (chunks / m) ** 3) * mean


def shuffled(seed):
    rng = random.Random(seed)
    rows = noise(seed)
    return [(" ".join(rng.sample(p.split(), len(p.split()))), r) for p, r in rows] + rows + [
        ("", "a"), ("a", ""), ("", ""), ("q", "z"), ("a b", "a b")
    ]


def test_meteor_equals_plain(spark):
    rows = shuffled(7)
    got = {r.sample_id: r for r in meteor_by_sample(texts(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, (p, r) in enumerate(rows):
        m, chunks, score = plain_meteor(p, r)
        assert (got[i].matches, got[i].chunks) == (m, chunks)
        assert got[i].meteor == pytest.approx(score)


def test_meteor_with_word_classes(spark):
    rows = shuffled(8)
    stems = {f"w{i}": f"s{i // 2}" for i in range(10)}
    senses = {f"w{i}": f"m{i // 5}" for i in range(12)}
    tables = [spark.createDataFrame(list(c.items()), "word string, class string") for c in (stems, senses)]
    got = {r.sample_id: r for r in meteor_by_sample(texts(spark, rows), classes=tables).collect()}
    for i, (p, r) in enumerate(rows):
        m, chunks, score = plain_meteor(p, r, (stems, senses))
        assert (got[i].matches, got[i].chunks) == (m, chunks)
        assert got[i].meteor == pytest.approx(score)


def test_greedy_match(spark, monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(7, 4)), rng.normal(size=(5, 4))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    table = unit(a) @ unit(b).T
    p, r = table.max(1).mean(), table.max(0).mean()
    wanted = 2 * p * r / (p + r)
    schema = "sample_id long, predicted_vecs array<array<double>>, neutral_vecs array<array<double>>"
    rows = spark.createDataFrame([(1, a.tolist(), b.tolist()), (2, [], b.tolist())], schema)
    got = {r.sample_id: r.bertscore_f1 for r in greedy_match_by_sample(rows).collect()}
    assert got[1] == pytest.approx(wanted) and got[2] == 0.0
    monkeypatch.setattr("tandem.operators.similarity.BLOCK", 2)
    assert _greedy_f1(a, b) == pytest.approx(wanted)


def test_similarity(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 0.0], [2.0, 0.0]), (2, [0.0, 0.0], [1.0, 0.0])],
        "sample_id long, predicted_vec array<float>, neutral_vec array<float>",
    )
    assert [r.similarity for r in similarity_by_sample(rows).orderBy("sample_id").collect()] == [1, 0]


def test_evaluate(spark):
    rows = texts(spark, noise(4))
    judged = rows.select("sample_id", F.lit(0.5).alias("score"))
    got = evaluate(rows, judged).first()
    assert tuple(got.asDict()) == METRICS
    assert got.bleu == pytest.approx(100 * plain_bleu(noise(4)))
    assert got.judge_score == 0.5 and got.bertscore_f1 == 0.0 and got.semantic_similarity is None
    empty = evaluate(rows.limit(0)).first()
    assert (empty.bleu, empty.meteor, empty.rouge1, empty.rougeL) == (-1, -1, -1, -1)


def test_evaluation_moves_texts_only_to_their_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = score_samples(texts(spark, noise(4)))
        plan = scores._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Texts for n-grams, texts for METEOR, and the small ROUGE-L rows; no n-grams.
    assert plan.count("Exchange ") == plan.count("Exchange hashpartitioning(sample_id") == 3


def test_whole_long_texts_count(spark):
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    rows = texts(spark, [(long, long + " tail")])
    assert rouge_l_by_sample(rows).first().rougeL == pytest.approx(2 * 20_000 / 40_001)
    counts = overlap_by_sample(rows, families=["rouge"]).first()
    assert (counts.rouge1_matched, counts.rouge1_reference) == (20_000, 20_001)
    assert meteor_by_sample(rows).first().matches == 20_000


def test_classifier_scores(spark):
    rows = [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(2, 0)]
    scored = spark.createDataFrame(rows, "label int, pred int")
    assert classify.accuracy(scored).first().accuracy == pytest.approx(5 / 7)
    f0, f1 = 2 * 3 / (4 + 4), 2 * 2 / (3 + 2)
    assert classify.weighted_f1(scored).first().f1 == pytest.approx((4 * f0 + 2 * f1 + 0) / 7)


def test_loss_summary(spark):
    steps = spark.createDataFrame([(0, s, float(s)) for s in range(1, 21)], "epoch long, step long, loss double")
    got = {(r.kind, r.at): r.loss for r in classify.loss_summary(steps).collect()}
    assert got == {("epoch", 0): 10.5, ("step", 10): 10.0, ("step", 20): 20.0}


def test_text_classifier_learns(spark):
    pairs = spark.createDataFrame(
        [(i, f"terrible awful thing {i}", f"plain thing {i}") for i in range(200)],
        "sample_id long, biased string, neutral string",
    )
    train, held = classify.hold_out(pairs, 0.2)
    assert train.count() + held.count() == 200
    scored = classify.classify_pairs(classify.train_text_classifier(train), held)
    assert classify.accuracy(scored).first().accuracy == 1.0


def test_meteor_keeps_tokens_in_their_row(spark):
    """Sorting unfolded tokens by sample, side and word spilled several times the texts."""
    table = spark.createDataFrame([("runs", "run"), ("run", "run")], "word string, class string")
    rows = texts(spark, [("a b runs", "a run b"), ("a", "a")])
    got = meteor_by_sample(rows, classes=[table])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning(sample_id" in plan
    assert [(r.matches, r.chunks) for r in got.orderBy("sample_id").collect()] == [(3, 3), (1, 1)]


def test_meteor_of_equal_and_null_keys(spark):
    some = [(1, "a b", "a c"), (1, "d", "d a"), (None, "a", "a"), (2, None, "a"), (3, "b", None)]
    rows = spark.createDataFrame(some, "sample_id long, predicted string, neutral string")
    got = {r.sample_id: (r.matches, r.chunks, r.predicted_words, r.reference_words) for r in meteor_by_sample(rows).collect()}
    assert got == {1: (2, 2, 3, 4), None: (1, 1, 1, 1), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0)}


def test_classifier_reads_the_words_of_a_text_once(spark):
    """Within a lambda the text was cut again for every one of its words."""
    rows = spark.createDataFrame([(1, 0, "a b a"), (1, 0, "c"), (2, 1, None)], "sample_id long, label int, text string")
    shares = classify._word_shares(rows, ["sample_id", "label"])
    assert shares._jdf.queryExecution().executedPlan().toString().count("split(lower(") == 1
    got = {r.sample_id: (r.rows, sorted((t.word, round(t.x, 3)) for t in r.shares)) for r in shares.collect()}
    assert got == {1: (2, [("a", 0.333), ("a", 0.333), ("b", 0.333), ("c", 1.0)]), 2: (1, [])}


def test_common_length_over_many_rows_of_a_batch(spark):
    rows = [(i, [f"w{j % (i % 7 + 1)}" for j in range(i % 5)], [f"w{j % 3}" for j in range(i % 4)]) for i in range(600)]
    frame = spark.createDataFrame([*rows, (600, None, ["a"])], "i int, a array<string>, b array<string>").coalesce(1)
    got = {r.i: r.n for r in frame.select("i", lcs_length("a", "b").alias("n")).collect()}
    assert got == {i: _common_length(a, b) for i, a, b in rows} | {600: 0}
