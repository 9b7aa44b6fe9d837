"""Ranking, distillation, outside calls and streams."""

import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tandem.operators import distil, enrich, ranking
from tandem.plans import distillation, judging, preferences, reasoning
from tandem.session import new_path, shared_folder, stage
from tandem.sources import logs
from tandem.streaming import jobs

RANKED = (
    "sample_id long, biased string, candidates array<struct<id:int,rank:int,text:string>>, "
    "judged array<struct<id:int,rank:int>>, reasoning string"
)


def ranked(spark, judged, texts=("gt", "a", "b", "c")):
    candidates = [(i, i, t) for i, t in enumerate(texts)]
    rows = spark.createDataFrame([(1, "src", candidates, judged, None)], RANKED)
    return ranking.rank_candidates(rows)


@pytest.mark.parametrize(
    "judged, order",
    [
        ([(0, 3), (1, 2), (2, 1), (3, 0)], "c b a gt"),
        ([(0, 1), (1, 1), (2, 1), (3, 1)], "gt a b c"),
        ([(2, 0), (9, 0)], "gt b a c"),  # unknown id ignored; ties by id
        ([(1, 0), (1, 5)], "gt b c a"),  # the last rank of an id stands
        (None, "gt a b c"),
        ([], "gt a b c"),
    ],
)
def test_order(spark, judged, order):
    row = ranked(spark, judged).first()
    assert " ".join(c.text for c in row.ranked) == order
    assert row.fallback == (judged is None)


def test_extremes_and_reference(spark):
    judged = F.col("judged")
    row = ranked(spark, [(3, 1), (1, 0), (2, 0), (0, 1)]).select(
        ranking.best_id(judged).alias("b"),
        ranking.worst_id(judged).alias("w"),
        ranking.reference_rank(judged).alias("r"),
    ).first()
    assert (row.b, row.w, row.r) == (1, 3, 1)
    stats = ranking.win_rate(ranked(spark, [(1, 0)])).first()
    assert (stats.win_rate, stats.unranked, stats.fallbacks) == (1.0, 1, 0)
    same = ranking.win_rate(ranked(spark, [(1, -1)], ("x", "x", "b", "c"))).first()
    assert same.win_rate == 1.0  # by text


def test_six_pairs(spark):
    got = ranking.preference_pairs(ranked(spark, [(0, 3), (1, 2), (2, 1), (3, 0)])).collect()
    assert [(r.chosen, r.rejected) for r in sorted(got, key=lambda r: r.pair_idx)] == [
        ("c", "b"), ("c", "gt"), ("b", "gt"), ("c", "src"), ("b", "src"), ("a", "src")
    ]


def test_report(spark):
    import json

    report = json.loads(ranking.ranking_report(ranked(spark, [(0, 1), (1, 2), (2, 1)])).first().report)
    assert [e["judge_rank"] for e in report["judge_sorted_list"]] == [2, 1, 1]
    assert [e["id"] for e in report["judge_sorted_list"]] == [1, 0, 2]
    assert report["reasoning"] is None and len(report["original_list"]) == 4


# --- distillation ---------------------------------------------------------------

TEACHER = "sample_id long, pos int, chosen struct<token:int,logprob:double>, top array<struct<token:int,logprob:double>>"


def plain_loss(logits, chosen, top, t, threshold=0.8):
    p, coverage = np.zeros(len(logits)), 0.0
    if chosen[0] is not None:
        p[chosen[0]] = math.exp(chosen[1] / t)
        coverage += p[chosen[0]]
    for token, logprob in top:
        if token is None or token == chosen[0]:
            continue
        p[token] = math.exp(logprob / t)
        coverage += p[token]
    x = np.array(logits) / t
    s = x - x.max() - math.log(np.exp(x - x.max()).sum())
    if coverage >= threshold:
        q = np.maximum(p / p.sum(), 1e-8)
        return float((q * (np.log(q) - s)).sum()), coverage
    return float(-(p[p > 0] * s[p > 0]).sum()), coverage


CASES = [
    ((0, -0.1), [(0, -0.1), (1, -2.0), (2, -4.0)]),
    ((0, -3.0), [(0, -3.0), (1, -4.0)]),
    ((2, -0.2), [(1, -1.0), (1, -3.0)]),  # repeated token: overwritten, counted twice
    ((None, -0.2), [(1, -0.1), (3, -1.0)]),  # a token without an id
    ((4, -0.5), [(4, -0.7), (None, -0.1)]),
]


def distil_tables(spark, cases, labels=(-100, -100, 0, 0, 0, 0, 0, 0)):
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(8, 6)).tolist()
    teacher = spark.createDataFrame([(1, i, c, t) for i, (c, t) in enumerate(cases)], TEACHER)
    student = spark.createDataFrame(
        [(1, i, row) for i, row in enumerate(logits)], "sample_id long, student_pos int, logits array<double>"
    )
    lab = spark.createDataFrame([(1, list(labels))], "sample_id long, labels array<int>")
    return teacher, student, lab, logits


def test_position_losses(spark):
    teacher, student, labels, logits = distil_tables(spark, CASES)
    got = {r.pos: r for r in distil.position_losses(teacher, student, labels).collect()}
    assert sorted(got) == list(range(len(CASES)))
    for pos, (chosen, top) in enumerate(CASES):
        loss, coverage = plain_loss(logits[pos + 1], chosen, top, 1.5)
        assert got[pos].loss == pytest.approx(loss)
        assert got[pos].coverage == pytest.approx(coverage)
        assert got[pos].low_coverage == (coverage < 0.8)


def test_student_too_short_and_empty_top(spark):
    cases = CASES[:2] + [((0, -1.0), [])] + CASES[:2]
    teacher, student, labels, _ = distil_tables(spark, cases)
    short = student.filter("student_pos < 4")
    positions = distil.position_losses(teacher, short, labels)
    assert sorted(r.pos for r in positions.collect()) == [0, 1]
    report = distil.coverage_report(positions, teacher).first()
    assert (report.used, report.total, report.few_used) == (2, 5, True)


def test_first_label_counts_drops_negative_position(spark):
    teacher, student, labels, _ = distil_tables(spark, CASES, labels=(0,) * 8)
    assert sorted(r.pos for r in distil.position_losses(teacher, student, labels).collect()) == [1, 2, 3, 4]


def test_all_masked_gives_hard_loss_only(spark):
    teacher, student, labels, _ = distil_tables(spark, CASES, labels=(-100,) * 8)
    hard = spark.createDataFrame([(1, 2.0)], "sample_id long, hard double")
    row = distillation.distillation_losses(teacher, student, labels, hard).first()
    assert (row.kl, row.loss) == (None, 2.0)


def test_sample_loss_and_mix(spark):
    teacher, student, labels, logits = distil_tables(spark, CASES)
    hard = spark.createDataFrame([(1, 2.0)], "sample_id long, hard double")
    row = distillation.distillation_losses(teacher, student, labels, hard).first()
    kl = np.mean([plain_loss(logits[i + 1], c, t, 1.5)[0] for i, (c, t) in enumerate(CASES)]) * 2.25
    assert row.kl == pytest.approx(kl) and row.loss == pytest.approx(0.5 * kl + 1.0)
    summary = distil.batch_summary(
        spark.createDataFrame([(1, 1.0), (2, 0.0), (3, None)], "sample_id long, kl double"), F.lit(0)
    ).first()
    assert (summary.kl_min, summary.kl_max, summary.kl_mean, summary.used, summary.total) == (0, 1, 0.5, 2, 3)


def test_divergence_of_a_distribution_with_itself_is_nil(spark):
    x = [0.3, -1.0, 2.0, 0.1]
    s = np.array(x) - math.log(np.exp(x).sum())
    top = [(i, float(v)) for i, v in enumerate(s)]
    teacher = spark.createDataFrame([(1, 0, top[2], top)], TEACHER)
    student = spark.createDataFrame([(1, 0, x)], "sample_id long, student_pos int, logits array<double>")
    labels = spark.createDataFrame([(1, [-100, 5])], "sample_id long, labels array<int>")
    loss = distil.position_losses(teacher, student, labels, temperature=1.0).first().loss
    assert loss == pytest.approx(0.0, abs=1e-9)


def test_token_ids(spark):
    entry = ("a", -0.5, [("a", -0.5), ("b", -1.0), ("zz", -2.0)])
    responses = spark.createDataFrame(
        [(1, [entry, ("b", -0.1, [])])], f"sample_id long, logprobs {logs.LOGPROBS_TYPE}"
    )
    vocabulary = spark.createDataFrame([("a", 7), ("b", 8)], "token string, token_id long")
    rows = distillation.with_token_ids(responses, vocabulary).orderBy("pos").collect()
    assert [tuple(rows[0].chosen), [tuple(t) for t in rows[0].top]] == [
        (7, -0.5), [(7, -0.5), (8, -1.0), (None, -2.0)]
    ]
    assert tuple(rows[1].chosen) == (8, -0.1) and rows[1].top == []


def test_first_piece(spark):
    entry = (" a", -0.5, [("b more", -1.0), (" ", -2.0)])
    responses = spark.createDataFrame([(1, [entry])], f"sample_id long, logprobs {logs.LOGPROBS_TYPE}")
    vocabulary = spark.createDataFrame([("a", 7), ("b", 8)], "token string, token_id long")
    row = distillation.with_token_ids(responses, vocabulary).first()
    assert tuple(row.chosen) == (7, -0.5) and [tuple(t) for t in row.top] == [(8, -1.0), (None, -2.0)]


def test_batch_loss(spark):
    rows = spark.createDataFrame([(0, 2.0, 1.0), (0, None, 3.0), (1, None, 0.0)], "batch long, kl double, hard double")
    got = {r.batch: r.loss for r in distil.batch_loss(rows, F.col("batch")).collect()}
    assert got == {0: 2.0, 1: 0.0}


# --- outside calls --------------------------------------------------------------


def counting(folder):
    """A call that leaves one file per use, fails for some and knows others."""

    def call(row):
        import uuid

        text = row.get("input") or row.get("biased")
        open(os.path.join(folder, f"{text}-{uuid.uuid4().hex}"), "w").close()
        if text.startswith("bad"):
            raise RuntimeError("no")
        if text.startswith("none"):
            return None
        return {"response": text.upper()}

    return call


def source(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "sample_id long, biased string")


def test_failed_calls(spark):
    rows = enrich.call_rows(
        source(spark, ["a", "bad" + "x" * 90, "none"]), counting("/tmp"), "response string", ["sample_id"]
    )
    got = {r.sample_id: (r.ok, r.response) for r in rows.collect()}
    assert got == {0: (True, "A"), 1: (False, None), 2: (False, None)}


def test_calls_pass_columns_through(spark):
    big = [(1, 9007199254740993, "a", [None, 3]), (2, None, None, None)]
    rows = spark.createDataFrame(big, "sample_id long, tag long, text string, ids array<int>")
    called = enrich.call_rows(rows, lambda row: {"n": row["sample_id"]}, "n long", ["sample_id"])
    predicted = enrich.batch_predict(rows, lambda texts: ["p"] * len(texts), text="text")
    for out in (called, predicted):
        assert sorted(tuple(r)[:4] for r in out.collect()) == big


def test_cache_calls_each_text_once(spark, folder):
    calls, log = folder + "/calls", folder + "/log"
    os.mkdir(calls)
    rows = source(spark, ["hot"] * 50 + ["a", "b", "bad"])
    for _ in range(2):
        got = enrich.cached_enrich(rows, "biased", log, counting(calls), "response string", ["sample_id"])
        found = {r.sample_id: r.response for r in got.collect()}
        assert len(found) == 53 and found[0] == found[49] == "HOT" and found[52] is None
    made = sorted(name.split("-")[0] for name in os.listdir(calls))
    assert made == ["a", "b", "bad", "bad", "hot"]  # only the failure is asked again


def test_resume_twice_equals_once(spark, folder):
    calls, log = folder + "/calls", folder + "/log"
    os.mkdir(calls)
    rows = source(spark, ["x", "y", "y", "bad", "z"])
    first = reasoning.generate(rows.limit(3), log, counting(calls), "m")
    assert sorted(r.response for r in first.collect()) == ["X", "Y", "Y"]  # copies are not merged
    again = reasoning.generate(rows, log, counting(calls), "m", commits=3)
    assert sorted(r.response for r in again.collect()) == ["X", "Y", "Y", "Z"]
    last = reasoning.generate(rows, log, counting(calls), "m").collect()
    assert len(last) == 4 and {r.model for r in last} == {"m"}
    assert all(r.prompt.endswith("Target Style: Neutral, unbiased\n\n\n") for r in last)


def test_calls_at_once_are_bounded(spark):
    def call(row):
        import time

        start = time.time()
        time.sleep(0.05)
        return {"start": start, "end": time.time()}

    rows = source(spark, [str(i) for i in range(60)])
    got = enrich.call_rows(rows, call, "start double, end double", ["sample_id"], max_concurrent=3).collect()
    assert len(got) == 60
    most = max(sum(o.start <= r.start < o.end for o in got) for r in got)
    assert most <= 3


def test_latest_by_key(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, r int, v string")
    got = {r.k: (r.r, r.v) for r in enrich.latest_by_key(log.withColumn("o", F.col("r")), ["k"], "o").collect()}
    assert got == {"a": (3, "z"), "b": (1, None)}


def test_batches_of_sixteen(spark):
    sizes = enrich.batch_predict(
        source(spark, [str(i) for i in range(40)]).coalesce(1), lambda texts: [str(len(texts))] * len(texts)
    )
    assert sorted(r.predicted for r in sizes.collect()) == ["16"] * 32 + ["8"] * 8


def test_judge_and_rewards(spark, folder):
    def call(row):
        kind = row["sample_id"]
        if kind == 0:
            raise RuntimeError("no")
        value = 9 if kind == 1 else 3
        assert row["messages"][1]["content"].count("MODEL OUTPUT") == 1
        return dict.fromkeys(judging_names(), value) | {"overall_reasoning": row["output"]}

    from tandem.functions.judging import SCORES

    def judging_names():
        return SCORES

    rows = spark.createDataFrame([(i, "b", f"o{i}", "r") for i in range(3)], "sample_id long, biased string, output string, reference string")
    scored = judging.judge(rows, call, "m/1", folder + "/log")
    assert [r.score for r in scored.orderBy("sample_id").collect()] == [0.0, 0.0, 1.0]
    assert [r.model_output for r in spark.read.parquet(folder + "/log").collect()] == ["o2"]
    mean = judging.judge_mean(scored).first()
    assert (mean.judge_score, mean.judge_score_ok, mean.failures) == (pytest.approx(1 / 3), 1.0, 2)
    given = spark.createDataFrame(
        [(5, "b", "r", [("assistant", "<think>t</think> out ")])],
        "sample_id long, biased string, neutral string, completions array<struct<role:string,content:string>>",
    )
    assert judging.reward_batch(given, call, "m", folder + "/rewards").first().reward == 1.0
    assert spark.read.parquet(folder + "/rewards").first().model_output == "out"


def test_teacher_cache(spark, folder):
    def call(row):
        assert row["messages"][1]["content"] == "Debias this sentence: " + row["biased"]
        if row["biased"] == "bad":
            return None
        return {"neutralized_text": "n", "model": "t", "logprobs": [
            {"token": "a", "logprob": -0.5, "top_logprobs": [{"token": "a", "logprob": -0.5}]}]}

    got = distillation.teacher_answers(source(spark, ["x", "bad"]), folder + "/log", call)
    rows = {r.biased: r.logprobs for r in got.collect()}
    assert rows["bad"] == [] and rows["x"][0].top_logprobs[0].token == "a"


def test_one_iteration(spark, folder):
    pairs = source(spark, [f"s{i}" for i in range(30)]).withColumn("neutral", F.concat(F.lit("n"), "sample_id"))
    planned = preferences.plan_iterations(pairs, size=25)
    got = preferences.iteration_pairs(
        planned, 1, lambda row: {"response": f"<think>x</think> t{row['temp_idx']}"}, lambda row: None, folder + "/ranks"
    ).collect()
    assert len(got) == 5 * 6 and {r.sample_id for r in got} == set(range(25, 30))
    assert sorted((r.chosen, r.rejected) for r in got if r.sample_id == 25) == sorted([
        ("n25", "t0"), ("n25", "t2"), ("t0", "t2"), ("n25", "s25"), ("t0", "s25"), ("t1", "s25")])
    assert os.listdir(folder + "/ranks").count("iteration=1") == 1


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert stage(spark.range(3), "t").count() == 3


# --- streams --------------------------------------------------------------------


def test_running_mean_equals_batch_after_replay(spark):
    path, out, state = (new_path(spark, n) for n in ("scores", "means", "state"))
    schema = "model string, score double"
    rows = [("a", 1.0), ("a", None), ("b", 0.5)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)

    def run():
        jobs.running_judge_mean(jobs.follow(spark, path, schema), out, state).awaitTermination()
        return {r.model: (r.rows, r.judge_score, r.failures) for r in jobs.read_judge_mean(spark, out).collect()}

    assert run() == {"a": (2, 0.5, 1), "b": (1, 0.5, 0)}
    spark.createDataFrame([("a", 1.0)], schema).coalesce(1).write.mode("append").parquet(path)
    assert run()["a"] == (3, pytest.approx(2 / 3), 1)
    jobs._folder_per_batch(out)(spark.createDataFrame([("a", 3, 2.0, 1)], "model string, rows bigint, total double, failures bigint"), 1)
    assert run()["a"] == (3, pytest.approx(2 / 3), 1)


def test_stream_dedupe_keeps_one_row_of_a_hot_key(spark):
    path, out, state = (new_path(spark, n) for n in ("in", "out", "state"))
    rows = spark.range(300).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"),
        F.timestamp_seconds(F.col("id")).alias("ts"),
    )
    rows.write.parquet(path)
    kept = jobs.dedupe_stream(jobs.follow(spark, path, "id long, k string, ts timestamp", 2), ["k"], "ts", "1 day", ["id"])
    jobs.write_stream(kept, out, state).awaitTermination()
    got = [r.k for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) == rows.select("k").distinct().count()


def test_stream_enrich_calls_new_keys_only(spark, folder):
    path, out, state = (new_path(spark, n) for n in ("in", "out", "state"))
    calls = folder + "/calls"
    os.mkdir(calls)

    def run():
        stream = jobs.follow(spark, path, "biased string")
        jobs.enrich_stream(stream, "biased", counting(calls), "response string", out, state).awaitTermination()
        return sorted(r.response for r in jobs.read_enriched(spark, out, "string", "biased", "response string").collect())

    spark.createDataFrame([("a",), ("a",), ("bad",)], "biased string").coalesce(1).write.parquet(path)
    assert run() == ["A"]
    spark.createDataFrame([("a",), ("c",), ("bad",)], "biased string").coalesce(1).write.mode("append").parquet(path)
    assert run() == ["A", "C"]
    assert sorted(n.split("-")[0] for n in os.listdir(calls)) == ["a", "bad", "bad", "c"]


def test_commits_keep_repeated_texts(spark, folder):
    from tandem.plans.reasoning import generate

    rows = [(i, f"text {i % 3}", "n") for i in range(30)]
    pairs = spark.createDataFrame(rows, "sample_id long, biased string, neutral string")
    sizes = {
        n: generate(pairs, f"{folder}/log-{n}", lambda row: {"response": "r"}, "m", commits=n).count()
        for n in (1, 4)
    }
    assert sizes == {1: 30, 4: 30}


def test_calls_hold_few_rows_and_send_back_no_requests(spark):
    """A worker held a whole batch of requests as Python objects, and sent them back."""
    batch = pa.RecordBatch.from_pydict({"n": list(range(600))})
    assert [b.num_rows for b in enrich.held(iter([batch]))] == [256, 256, 88]
    rows = source(spark, [str(i) for i in range(600)]).withColumn("request", F.col("biased")).coalesce(1)
    called = enrich.call_rows(rows, lambda row: {"n": int(row["request"])}, "n long", ["sample_id"], only_asked=["request"])
    assert called.columns == ["sample_id", "biased", "n", "ok", "error"]
    assert all(r.ok and r.n == r.sample_id for r in called.collect())
