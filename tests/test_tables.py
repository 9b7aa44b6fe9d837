"""Scans, sinks, ordinals, splits, skewed joins, vocabularies."""

import os
import re
from collections import Counter

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tandem.operators import bounds, skew
from tandem.operators.blocks import TokenBlocks
from tandem.operators.builders import BUILDERS, build_dataset, pair_vocabulary
from tandem.operators.ordinals import with_file_ordinals, with_ordinals
from tandem.operators.splits import assign_batches, batch_rows, split_overlap, split_pairs, take_split
from tandem.operators.vocabulary import Vocabulary, block_vocabulary
from tandem.sources import corpus, logs


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


LINES = [
    "1\ts\tt\tbias one\tplain one\tP\tQ",
    "2\ts\tt\tbias two\tNA\tP\tQ",
    "3\ts\tt\tbias three",
    "4\ts\tt\tbias four\tplain four\tP\tQ\textra",
    '5\ts\tt\t"open quote\tplain five\tP\tQ',
    "6\ts\tt\t\tplain six\tP\tQ",
]


def test_corpus_scan(spark, folder):
    path = write(folder, "c.tsv", "\n".join(LINES) + "\n")
    rows = corpus.scan_corpus(spark, path).orderBy("id").collect()
    assert [r.id for r in rows] == ["1", "2", "3", "5", "6"]
    assert rows[2].tgt_raw is None and rows[3].src_raw == '"open quote'
    assert [r.line for r in corpus.scan_over_long(spark, path).collect()] == [LINES[3]]
    pairs = corpus.load_pairs(spark, path).orderBy("id").collect()
    assert [(r.id, r.biased, r.neutral) for r in pairs] == [
        ("1", "bias one", "plain one"),
        ("5", '"open quote', "plain five"),
    ]


def test_corpus_scan_with_quotes(spark, folder):
    quoted = '1\ts\tt\t"a\tb"\tplain\tP\tQ\n' + LINES[3] + "\n"
    rows = corpus.scan_corpus(spark, write(folder, "q.tsv", quoted), quote='"').collect()
    assert [(r.id, r.src_raw) for r in rows] == [("1", "a\tb")]


def test_corpus_must_exist(spark, folder):
    with pytest.raises(AnalysisException):
        corpus.scan_corpus(spark, folder + "/none").collect()


def test_missing_marks(spark):
    texts = [("NA",), ("null",), ("",), ("nanny",), ("N/A",), (None,), ("none",)]
    got = corpus.normalise_missing(spark.createDataFrame(texts, "t string"), ["t"])
    assert [r.t for r in got.collect()] == [None, None, None, "nanny", None, None, "none"]


def test_predictions_round_trip(spark, folder):
    texts = ['plain', 'with "quotes", and comma', "two\nlines", "", "\\ back"]
    rows = spark.createDataFrame(
        [(i, "b", "n", t) for i, t in enumerate(texts)], "i int, biased string, neutral string, predicted string"
    )
    path = folder + "/p"
    logs.write_predictions(rows.repartition(1).sortWithinPartitions("i"), path)
    logs.write_predictions(rows.repartition(1).sortWithinPartitions("i"), path)
    got = logs.scan_predictions(spark, path).orderBy("row_idx").collect()
    assert [(r.row_idx, r.predicted or "") for r in got] == list(enumerate(texts))


def test_file_order(spark, folder):
    for part in range(5):
        write(folder, f"part-{part}.csv", "".join(f"{part * 100 + at}\n" for at in range(50 + part)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        rows = with_file_ordinals(spark.read.schema("v int").csv(folder)).orderBy("row_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.row_idx for r in rows] == list(range(260))
    assert [r.v for r in rows] == [p * 100 + at for p in range(5) for at in range(50 + p)]


def test_teacher_scan(spark, folder):
    good = '{"biased_text":"a","logprobs":[{"token":"x","logprob":-0.5,"top_logprobs":[]}]}'
    text = "\n".join([good, "", '{"biased_text":"","logprobs":[{"token":"x","logprob":-1}]}',
                      '{"biased_text":"b","logprobs":[]}', '{"biased_text":"c"}', "{broken", good.replace('"a"', '"d"')])
    write(folder, "t.jsonl", text + "\n")
    counts = Observation("lines")
    assert sorted(r.biased_text for r in logs.scan_teacher(spark, folder, counts).collect()) == ["a", "d"]
    assert counts.get == {"blank": 1, "broken": 1, "empty": 3, "used": 2}
    assert logs.scan_teacher(spark, folder + "/none").count() == 0
    assert logs.scan_table(spark, folder + "/none", "a int").count() == 0


def test_appends(spark, folder):
    row = ("o", "b", "r", "m/1.0", True, 1, 2, 3, -3, "why", 0.0)
    schema = ("output string, biased string, reference string, model string, ok boolean, neutrality int, "
              "meaning_preservation int, fluency int, edit_minimality int, overall_reasoning string, score double")
    scored = spark.createDataFrame([row, row[:4] + (False,) + row[5:]], schema)
    for _ in range(2):
        logs.append_judge_scores(scored, folder + "/j")
        logs.append_judge_csv(scored, folder + "/c")
    assert spark.read.parquet(folder + "/j").count() == 2
    assert "model_slug=m_10" in os.listdir(folder + "/j")
    csv = spark.read.option("header", True).csv(folder + "/c")
    assert tuple(csv.columns) == logs.JUDGE_COLUMNS and csv.count() == 2


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_ordinals(spark, parts):
    rows = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("k")).repartition(parts)
    got = with_ordinals(rows, [F.desc("k")]).orderBy("row_idx").collect()
    assert [(r.row_idx, r.k) for r in got] == [(i, 999 - i) for i in range(1000)]


def test_splits(spark, monkeypatch):
    rows = spark.range(40).select(
        F.col("id").alias("sample_id"), F.lit("b").alias("biased"),
        F.when(F.col("id") % 4 != 0, "n").alias("neutral"),
    )
    sizes = {"train": 10, "validation": 5, "test": 6}

    def ids(split):
        return sorted(r.sample_id for r in take_split(rows, split, **sizes).collect())

    wanted = {"train": list(range(10)), "validation": list(range(10, 15)), "test": list(range(34, 40))}
    for split, expected in wanted.items():
        assert ids(split) == expected
    assert len(ids("full")) == 40
    assert split_pairs(rows, "train", **sizes).count() == 7
    for name, value in (("HELD", 3), ("SAMPLE", 4)):  # the bound is searched for in several rounds
        monkeypatch.setattr(f"tandem.operators.bounds.{name}", value)
    for split, expected in wanted.items():
        assert ids(split) == expected
    with pytest.raises(ValueError):
        take_split(rows, "other")


@pytest.mark.parametrize("text", [False, True])
def test_key_bounds(spark, monkeypatch, text, folder):
    for name, value in (("HELD", 20), ("SAMPLE", 8)):
        monkeypatch.setattr(f"tandem.operators.bounds.{name}", value)
    values = [f"k{i * 37 % 1000}é{i}" if text else i * i for i in range(700)]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], f"k {'string' if text else 'long'}").repartition(4)
    ranks = [0, 1, 350, 698, 699, 700, -1, -699, -5000]
    order = sorted(values)
    want = [order[max(0, 700 + r) if r < 0 else r] if r < 700 else None for r in ranks]
    assert bounds.key_bounds(rows, "k", ranks) == want
    rows.write.parquet(folder + "/t")
    part = take_split(spark.read.parquet(folder + "/t"), "validation", "k", 300, 50, 10)
    assert sorted(r.k for r in part.collect()) == order[300:350]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(k), GreaterThanOrEqual(k," in plan and "Sort" not in plan and "Exchange" not in plan


def test_batch_rows_equal_assigned_batches(spark):
    rows = spark.range(53).select((F.col("id") * 3 + 1).alias("sample_id"), F.lit("t").alias("text")).repartition(3)
    every = {r.sample_id: tuple(r) for r in assign_batches(rows, size=10).collect()}
    for iteration in (0, 3, 5, 6):
        got = batch_rows(rows, iteration, size=10).select("sample_id", "text", "row_idx", "iteration", "sample_idx").collect()
        assert {r.sample_id: tuple(r) for r in got} == {k: v for k, v in every.items() if v[3] == iteration}


def test_small_corpus_splits_overlap(spark):
    rows = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(9)], "sample_id long, biased string")
    got = split_overlap(rows, train=6, validation=2, test=4).collect()
    found = {(r.split_a, r.split_b, r.shared): r.rows for r in got}
    assert found["train", "test", "row"] == 1
    assert found["train", "validation", "row"] == 0
    assert found["train", "test", "text"] == 4


def test_batches(spark):
    got = assign_batches(spark.range(53).withColumnRenamed("id", "sample_id")).orderBy("sample_id").collect()
    assert [(r.iteration, r.sample_idx) for r in got] == [(i // 25, i % 25) for i in range(53)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k")
    ).unionByName(spark.createDataFrame([(9999, None)], "id long, k string"))
    right = spark.range(400).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
    right = right.unionByName(spark.createDataFrame([("hot", -1)], "k string, v long"))
    plain = left.join(right, ["k"], how)
    salted = skew.salted_join(left, right, ["k"], how, min_rows=100, spread_by=["id"])
    assert salted.columns == plain.columns
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_hot_rows_are_spread(spark):
    left = spark.range(1000).select("id", F.lit("hot").alias("k"))
    assert len(skew.hot_hashes(left, ["k"], 100)) == 1
    assert skew.hot_hashes(left, ["k"], 2000) == []


def test_lookup_join_beyond_broadcast(spark, monkeypatch):
    left = spark.createDataFrame([(i, f"k{i % 3}") for i in range(9)], "id long, k string")
    table = spark.createDataFrame([("k0", 1), ("k1", 2)], "k string, v int")
    small = sorted(map(str, skew.lookup_join(left, table, ["k"]).collect()))
    assert skew.small_enough(table) and not skew.small_enough(table.select(F.array("v")))
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 1)
    assert not skew.small_enough(table)
    assert sorted(map(str, skew.lookup_join(left, table, ["k"]).collect())) == small


TEXTS = [(1, ["b", "a", "b"]), (2, ["c", "b"]), (3, []), (4, ["x" * 100, "a"])]


def test_vocabulary(spark):
    texts = spark.createDataFrame(TEXTS, "id long, tokens array<string>")
    vocab = Vocabulary.of(texts)
    ids = {r.token: (r.n, r.token_id) for r in vocab.table.collect()}
    assert ids == {"b": (3, 2), "a": (2, 3), "c": (1, 4), "x" * 100: (1, 5)}

    def encoded(v):
        return {r.id: (r.t, r.u) for r in v.encode(
            texts, "id", {"t": F.col("tokens"), "u": F.slice("tokens", 1, 1)}).collect()}

    wanted = {1: ([2, 3, 2], [2]), 2: ([4, 2], [4]), 3: ([], []), 4: ([5, 3], [5])}
    assert encoded(vocab) == wanted
    assert vocab.ids_of(["a", "zz"]) == {"a": 3}


def test_unknown_tokens(spark):
    vocab = Vocabulary.of(spark.createDataFrame([(["a"],)], "tokens array<string>"))
    other = spark.createDataFrame([(1, ["a", "q"])], "id long, t array<string>")
    assert vocab.encode(other, "id", {"t": F.col("t")}).first().t == [2, 1]


@pytest.mark.parametrize("block_tokens", [1, 3, 1 << 20])
def test_token_blocks(spark, block_tokens):
    """Blocks of any size, rows without tokens, repeated keys and tokens that are null or unknown."""
    rows = [*TEXTS, (5, None), (1, ["c"]), (6, ["a", None, "b"]), (None, ["b"])]
    texts = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(3)
    parts = {"t": F.col("tokens"), "u": F.slice("tokens", 2, 2)}
    blocks = TokenBlocks.of(texts.withColumn("note", F.lit("n")), ["id", "note"], parts, block_tokens)
    assert blocks.rows() == len(rows)
    want, want_u = Counter(), Counter()
    for _, own in rows:
        want.update(t for t in own or [] if t)
        want_u.update(t for t in (own or [])[1:3] if t)
    assert {r.token: r.n for r in blocks.counts({"t": 1}).collect()} == want
    assert {r.token: r.n for r in blocks.counts({"u": 2}).collect()} == {t: 2 * n for t, n in want_u.items()}
    vocab = block_vocabulary(TokenBlocks.of(texts.where("id < 3"), [], {"t": F.col("tokens")}))
    ids = {r.token: r.token_id for r in vocab.table.collect()}
    got = sorted((r.id or 0, r.note, r.t, r.u) for r in vocab.encode_blocks(blocks).collect())
    assert got == sorted(
        (i or 0, "n", [ids.get(t, 1) for t in own or []], [ids.get(t, 1) for t in (own or [])[1:3]]) for i, own in rows
    )
    none = TokenBlocks.of(texts.where("id > 99"), ["id"], {"t": F.col("tokens")})
    assert vocab.encode_blocks(none).count() == 0 and none.rows() == 0


def test_encoding_leaves_rows_in_place(spark):
    """The written rows are joined as they lie, also where nothing may be broadcast."""
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = spark.createDataFrame([(i, [f"t{i % 7}", f"t{i % 50}"]) for i in range(300)], "id long, tokens array<string>")
        blocks = TokenBlocks.of(texts.repartition(5), ["id"], {"t": F.col("tokens")}, 40)
        encoded = block_vocabulary(blocks).encode_blocks(blocks)
        assert encoded.count() == 300
        plan = encoded._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    (scan,) = re.findall(r".*\n.*FileScan.*_rows.*", plan.split("== Initial Plan ==")[0])
    above, below = scan.split("\n")
    assert "Join" in above and "Bucketed: true" in below


def test_builders(spark):
    pairs = spark.createDataFrame(
        [(1, "One bias.", "\n\nOne."), (2, "Two", "Two two")], "sample_id long, biased string, neutral string"
    )
    vocab = pair_vocabulary(pairs)
    columns = {
        "SFT": {"input_ids", "labels", "attention_mask"},
        "EVAL": {"input_ids", "labels", "attention_mask", "tokenized_input", "biased", "neutral"},
        "DISTIL": {"input_ids", "labels", "attention_mask", "tokenized_input", "biased"},
        "GRPO": {"prompt", "biased", "neutral"},
        "DPO": {"prompt", "formatted_prompt", "biased", "neutral"},
        "BinaryClassification": {"input_ids", "labels", "attention_mask"},
    }
    assert set(columns) == set(BUILDERS)
    for task, wanted in columns.items():
        assert set(build_dataset(pairs, task, vocab).columns) == wanted | {"sample_id"}
    rows = build_dataset(pairs, "SFT", vocab).orderBy("sample_id").collect()
    assert all(len(r.input_ids) == len(r.labels) == len(r.attention_mask) == 512 for r in rows)
    names = {r.token_id: r.token for r in vocab.table.collect()}
    for row, answer in zip(rows, (["One", "."], ["Two", "two"])):
        start = next(i for i, label in enumerate(row.labels) if label != -100)
        assert [names[i] for i in row.labels[start : start + 2]] == answer
        assert row.labels[start:] == row.input_ids[start:]
        assert Counter(row.attention_mask)[1] == sum(i != 0 for i in row.input_ids)
    two = build_dataset(pairs, "BinaryClassification", vocab, length=8).collect()
    assert sorted((r.sample_id, r.labels) for r in two) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    short = build_dataset(pairs, "SFT", vocab, length=4).collect()
    assert all(r.labels == [-100] * 4 for r in short)


@pytest.mark.parametrize("other, thinking_off", [(False, True), (False, False), (True, False), (True, True)])
def test_chat_tokens_join_at_the_cuts(spark, other, thinking_off):
    """Tokens of the pieces are the tokens of the whole, whatever the texts hold."""
    from tandem.functions import prompts
    from tandem.functions.text import chat_tokens
    from tandem.operators import builders

    nasty = ["", "\n", "\n\nx\n", "<", "<|im_", "|>", "<|im_end|", "a", " a ", "9\t", "é", "<|im_end|>"]
    pairs = spark.createDataFrame([(a, b) for a in nasty for b in nasty], "biased string, neutral string")
    tags = prompts.ChatTags("<|open|>", "<|role|>\n\n", "<|shut|>") if other else prompts.CHATML
    block = F.lit(tags.no_thinking if thinking_off else "")
    chat = prompts.sft_messages(F.col("biased"), F.concat(block, F.col("neutral")))
    cut = builders.training_template(tags, thinking_off)
    pieces = F.concat(
        F.lit(cut.before), builders._source_tokens(), F.lit(cut.between[:-1]), cut.answer_tokens(), F.lit(cut.after)
    )
    asked = prompts.render_chat(
        prompts.first_turns(chat, 2), generation_prompt=True, thinking_off=thinking_off, tags=tags
    )
    opened = F.concat(F.lit(cut.before), builders._source_tokens(), F.lit(cut.between))
    rows = pairs.select(
        (chat_tokens(prompts.render_chat(chat, tags=tags)) == pieces).alias("whole"),
        (chat_tokens(asked) == opened).alias("prompt"),
    )
    assert rows.filter("whole and prompt").count() == len(nasty) ** 2
