"""The keyed log: layout, merges, replays, what a batch reads; staged tables that go with their job."""

import os

import pytest
from pyspark.sql import functions as F

from tandem.operators import enrich
from tandem.operators.blocks import TokenBlocks
from tandem.operators.vocabulary import block_vocabulary
from tandem.plans.evaluate import evaluate
from tandem.session import job, shared_folder, stage
from tandem.sources.keyed_log import KeyedLog, key_hash


def rows(spark, entries):
    return spark.createDataFrame(entries, "text string, answer string, revision long")


def opened(spark, folder, **options):
    return KeyedLog(spark, folder + "/log", "text", "string", "answer string", **options)


def test_latest_over_commits_and_merges(spark, folder):
    log, want = opened(spark, folder, buckets=4, fan=2), {}
    for at in range(9):
        entries = [(f"k{k}", f"a{at}-{k}", at) for k in range(at, at + 6)] + [(f"k{at}", "older", -1), (None, f"n{at}", at)]
        log.append(rows(spark, entries), batch=at)
        want |= {k: a for k, a, r in entries if k and r >= 0}
    for now in (log, opened(spark, folder, buckets=64)):  # a log keeps its own number of buckets
        assert {r.text: r.answer for r in now.latest().collect()} == want
        assert now.n == 4 and now.holds_batch(8) and not now.holds_batch(9)
    levels = [e.level for e in log.commits]
    assert len(levels) <= 4 and max(levels) >= 2 and all(levels.count(x) < 2 for x in levels)
    assert len([n for n in os.listdir(folder + "/log/manifest") if n.endswith(".json")]) <= 2
    log.append(rows(spark, []), batch=12)  # a batch without answers is known as well
    assert opened(spark, folder).holds_batch(12) and len(opened(spark, folder).latest().collect()) == len(want)


def test_a_batch_reads_what_it_touches(spark, folder):
    """Files read for one key stay few, however long the log grows; no text is a join key."""
    log = opened(spark, folder, buckets=8, fan=3)
    keys = log.hashed(spark.createDataFrame([("k1",), ("new",)], "text string"))
    read = []
    for at in range(14):
        log.append(rows(spark, [(f"k{at}x{i}", "a", at) for i in range(20)] + [("k1", f"a{at}", at)]))
        read.append(len(log.paths(log.touched(keys))))
    assert max(read) <= 2 * 2 * 3 and max(read[7:]) < 14
    missing = log.missing(keys)
    assert [r.text for r in missing.collect()] == ["new"]
    plan = missing._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.split("\n") if "Join" in line)
    assert "_hash" in join and "text" not in join
    assert len(missing.inputFiles()) <= max(read)


def test_unfinished_commits_are_not_read(spark, folder, monkeypatch):
    log = opened(spark, folder)
    log.append(rows(spark, [("a", "1", 1)]))
    monkeypatch.setattr(KeyedLog, "_publish", lambda self, entries: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        log.append(rows(spark, [("b", "2", 2)]))
    assert [r.text for r in opened(spark, folder).latest().collect()] == ["a"]


def test_hashes_tell_keys_apart(spark):
    pairs = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "c"), ("-", "c"), ("1:-", "c")], "x string, y string")
    assert pairs.select(key_hash("x", "y").alias("h")).distinct().count() == 5


def test_pending_rows_are_found_once(spark, folder):
    """One reading of source and log for all commits, and no salting job."""
    source = spark.createDataFrame([(i, f"t{i % 30}") for i in range(300)], "sample_id long, biased string")
    log = spark.createDataFrame([("t1",), ("t2",), ("t2",)], "biased string")
    pending = enrich.pending_commits(source, log, "biased", 3)
    assert pending.count() == 280 and {r._commit for r in pending.select("_commit").distinct().collect()} <= {0, 1, 2}
    plan = enrich.not_logged(source, log, "biased")._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan and "LeftAnti, (_hash" in plan


def test_staged_tables_go_with_their_job(spark):
    before = set(os.listdir(shared_folder(spark)))
    texts = spark.createDataFrame([(1, "a b c", "a b"), (2, "x", "y")], "sample_id long, predicted string, neutral string")
    with job(spark):
        assert evaluate(texts).first().rouge1 > 0
        assert set(os.listdir(shared_folder(spark))) > before
    assert set(os.listdir(shared_folder(spark))) == before
    with job(spark):
        blocks = TokenBlocks.of(texts, ["sample_id"], {"t": F.split("neutral", " ")})
        block_vocabulary(blocks).encode_blocks(blocks).collect()
        held = {t.name for t in spark.catalog.listTables()}
    assert set(os.listdir(shared_folder(spark))) == before
    assert len(held - {t.name for t in spark.catalog.listTables()}) == 1
    kept = stage(texts, "kept")
    assert kept.count() == 2 and set(os.listdir(shared_folder(spark))) > before
