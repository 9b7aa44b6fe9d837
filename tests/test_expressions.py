"""Row-local expressions on hand-worked values."""

import pytest
from pyspark.sql import functions as F

from tandem.functions import arrays, prompts
from tandem.functions import text as tx
from tandem.functions.judging import judge_score, judge_total, judge_valid


def one(spark, text, expression):
    rows = spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("v"))
    return rows.first().v


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("<think>a\nb</think>\n hi ", "hi"),
        ("<think>x</think>mid<think>y</think> ", "mid"),
        ("<think>open hi", "<think>open hi"),
        ("", ""),
        (" \t\n", ""),
        (" 　hi ", "hi"),
        (None, None),
    ],
)
def test_strip_think(spark, text, wanted):
    assert one(spark, text, tx.strip_think) == wanted


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("<think>a</think> b </think> c ", "c"),
        ("before <think>Okay so\n\n  Let me see\n  answer \nmore", "answer"),
        ("before <think>Okay\nFirst\n ", "before"),
        (" plain ", "plain"),
        ("<think>", ""),
    ],
)
def test_clean_output(spark, text, wanted):
    assert one(spark, text, tx.clean_output) == wanted


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("x [Transferred]: a", "a"),
        ("[Transferred]: a\n[Transferred]:  b ", "b"),
        ("none", None),
        ("[Transferred]:", ""),
    ],
)
def test_transferred(spark, text, wanted):
    assert one(spark, text, tx.transferred) == wanted


def test_path_slug(spark):
    assert one(spark, "judge_scores.csv", tx.path_slug) == "judge_scorescsv"
    assert one(spark, "a/b c.d", tx.path_slug) == "a_b_cd"


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("Hello, world!", ["Hello", ",", "world", "!"]),
        ("It costs 1,000.50 today.", ["It", "costs", "1,000.50", "today", "."]),
        ("a well-known 5-year plan", ["a", "well-known", "5", "-", "year", "plan"]),
        ("&quot;x&quot; &amp; y", ['"', "x", '"', "&", "y"]),
        ("it's", ["it's"]),
        ("line-\nbreak\nhere", ["linebreak", "here"]),
        ("", []),
    ],
)
def test_tokens_13a(spark, text, wanted):
    assert one(spark, text, tx.tokens_13a) == wanted


@pytest.mark.parametrize("text", ["plain", "it's", 'say "x"', 'both \' and "', "tab\tnl\nback\\"])
def test_quoted_is_a_python_literal(spark, text):
    assert one(spark, text, prompts.quoted) == repr(text)


def test_prompts(spark):
    rows = spark.createDataFrame([("B", "N")], "b string, n string")
    chat = rows.select(prompts.sft_messages(F.col("b"), F.col("n")).alias("m")).first().m
    assert [turn.role for turn in chat] == ["system", "user", "assistant"]
    assert chat[1].content.endswith("from biased to neutral.:\nBiased text: B")
    assert chat[2].content == "N"
    judged = rows.select(prompts.judge_prompt(F.col("b"), F.col("n"), F.col("b")).alias("p"))
    assert judged.first().p == (
        "\n        BIAS INPUT:\n        B\n\n        MODEL OUTPUT:\n        N\n\n"
        "        REFERENCE (human neutral text):\n        B\n        "
    )


def test_render_chat(spark):
    chat = prompts.messages(("user", F.lit("hi")))
    row = spark.range(1).select(
        prompts.render_chat(chat).alias("a"),
        prompts.render_chat(chat, generation_prompt=True, thinking_off=True).alias("b"),
    ).first()
    assert row.a == "<|im_start|>user\nhi<|im_end|>\n"
    assert row.b == row.a + "<|im_start|>assistant\n<think>\n\n</think>\n\n"


def test_pad_truncate(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([],), ([1, 2, 3, 4, 5],)], "t array<int>")
    ids = F.col("t")
    got = rows.select(
        arrays.pad_truncate(ids, 4, 0).alias("right"),
        arrays.pad_truncate(ids, 4, 0, "left").alias("left"),
        arrays.attention_mask(ids, 4).alias("mask"),
        arrays.attention_mask(ids, 4, "left").alias("left_mask"),
    ).collect()
    assert [r.right for r in got] == [[1, 2, 3, 0], [0] * 4, [1, 2, 3, 4]]
    assert [r.left for r in got] == [[0, 1, 2, 3], [0] * 4, [1, 2, 3, 4]]
    assert [r.mask for r in got] == [[1, 1, 1, 0], [0] * 4, [1] * 4]
    assert [r.left_mask for r in got] == [[0, 1, 1, 1], [0] * 4, [1] * 4]


def test_pad_id(spark):
    row = spark.range(1).select(
        arrays.pad_id_or_eos(F.lit(None).cast("int"), F.lit(7)).alias("a"),
        arrays.pad_id_or_eos(F.lit(3), F.lit(7)).alias("b"),
    ).first()
    assert (row.a, row.b) == (7, 3)


@pytest.mark.parametrize(
    "full, prompt, wanted, start",
    [
        ([5, 6, 271, 198, 9, 0], [5, 6], [-100, -100, -100, -100, 9, 0], 4),
        ([5, 6, 9, 0], [5, 6, 0], [-100, -100, 9, 0], 2),
        ([271, 198], [], [-100, -100], None),
        ([5, 6], [5, 6, 7], [-100, -100], None),
        ([5, 6], [], [5, 6], 0),
    ],
)
def test_label_mask(spark, full, prompt, wanted, start):
    rows = spark.createDataFrame([(full, prompt)], "f array<int>, p array<int>")
    labels = arrays.label_mask(F.col("f"), F.col("p"), 0)
    row = rows.select(labels.alias("l")).select("l", arrays.response_start(F.col("l")).alias("s"))
    assert (row.first().l, row.first().s) == (wanted, start)


def test_label_mask_can_hide_filling(spark):
    rows = spark.createDataFrame([([5, 9, 0], [5])], "f array<int>, p array<int>")
    labels = arrays.label_mask(F.col("f"), F.col("p"), 0, mask_pads=True)
    assert rows.select(labels.alias("l")).first().l == [-100, 9, -100]


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    zero = F.array(F.lit(0.0), F.lit(0.0))
    row = rows.select(
        arrays.cosine(F.col("a"), F.col("b")).alias("c"),
        arrays.cosine(F.col("a"), zero).alias("z"),
        arrays.argmax(F.col("b")).alias("m"),
        arrays.log_softmax(F.col("b")).alias("s"),
    ).first()
    assert row.c == pytest.approx(0.5**0.5) and row.z == 0.0 and row.m == 0
    assert row.s == pytest.approx([-0.6931471805599453] * 2)


def test_judging(spark):
    schema = (
        "neutrality int, meaning_preservation int, fluency int, edit_minimality int"
    )
    rows = spark.createDataFrame([(3, 3, 3, 3), (-3, -3, -3, -3), (4, 0, 0, 0), (1, None, 0, 0)], schema)
    got = rows.select(
        judge_valid().alias("v"), judge_total().alias("t"), judge_score().alias("s")
    ).collect()
    assert [r.v for r in got] == [True, True, False, False]
    assert [r.s for r in got] == [1.0, -1.0, 0.0, 0.0]
    assert got[0].t == 1.0
