"""Restartable runs, evaluation from split to log, stems, and tables removed with their job."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tandem.functions.stems import stems
from tandem.operators.sequences import meteor_by_sample
from tandem.plans.evaluation import eval_model, existing_predictions
from tandem.plans.runs import Run
from tandem.sources import logs

# Published pairs of the rules, and words of the extensions.
STEMS = """caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster bled bled motoring motor
sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss fizzed fizz filing file
happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit radicalli radic
vileli vile vietnamization vietnam operator oper feudalism feudal decisiveness decis callousness callous formaliti formal
sensibiliti sensibl triplicate triplic formative form electrical electr hopeful hope goodness good revival reviv
inference infer gyroscopic gyroscop adjustable adjust irritant irrit replacement replac adoption adopt communism commun
bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll dying die skies sky enjoy enjoy
dies die spied spi died die syzygy syzygi apologies apolog as as by by""".split()


def test_stems(spark):
    want = dict(zip(STEMS[::2], STEMS[1::2], strict=True))
    rows = [(w,) for w in want] * 2 + [(None,), ("",)]
    got = {r.word: r["class"] for r in stems(spark.createDataFrame(rows, "word string")).collect()}
    assert got == want | {"": ""}


def test_meteor_by_stems(spark):
    texts = spark.createDataFrame([(1, "cats were hopping", "the cat hopped"), (2, "x", "y")], "sample_id long, predicted string, neutral string")
    words = spark.createDataFrame([(w,) for w in "cats were hopping the cat hopped x y".split()], "word string")
    got = {r.sample_id: (r.matches, r.chunks) for r in meteor_by_sample(texts, classes=[stems(words)]).collect()}
    assert got == {1: (2, 2), 2: (0, 0)}


def counted(folder: str):
    """A stand-in that leaves a file for each batch it is given."""

    def predict(prompts: list[str]) -> list[str]:
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
            out.write(str(len(prompts)))
        return [p.rpartition("Make this neutral: ")[2].partition("<|im_end|>")[0].upper() for p in prompts]

    return predict


def calls(folder: str) -> int:
    return sum(int(open(os.path.join(folder, f)).read()) for f in os.listdir(folder))


def test_run_goes_on_after_its_last_finished_step(spark, folder, tmp_path):
    pairs = spark.createDataFrame(
        [(i, f"biased {i}, \"so\"\nbad", None if i % 4 == 0 else f"neutral {i}") for i in range(40)],
        "sample_id long, biased string, neutral string",
    )
    made = tmp_path / "calls"
    made.mkdir()
    scores = {"neutrality": 3, "meaning_preservation": 3, "fluency": 3, "edit_minimality": 3, "overall_reasoning": "r"}
    sizes = {"test": 20}

    def evaluate(judge, model="m/1", **options):
        return eval_model(pairs, folder, model, counted(str(made)), judge, "j", sizes=sizes, **options)

    def stopped(predicted):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):  # ended after the prediction and the judgements
        evaluate(lambda row: scores, vectors=stopped)
    assert calls(made) == 15
    rows = {r.key: r for r in evaluate(lambda row: 1 / 0).collect()}  # judged already: this call is not made
    assert calls(made) == 15 and rows["judge_score"].number == 1.0 and rows["test_dataset_size"].text == "15"
    again = evaluate(lambda row: 1 / 0)
    assert calls(made) == 15 and again.count() == len(rows) == 13  # the log is not doubled
    assert {r.run for r in again.collect()} == {"eval_m_1"}
    path = f"{folder}/predictions/m_1"
    assert logs.scan_predictions(spark, path).orderBy("row_idx").first().predicted == 'BIASED 21, "SO"\nBAD'
    # another model is another prediction, and all that follows from it
    other = evaluate(lambda row: scores, "m/2")
    assert calls(made) == 30 and {r.run for r in other.collect()} == {"eval_m_1", "eval_m_2"}
    # predictions of an earlier file, by position
    test = spark.read.parquet(*[f"{folder}/{f}" for f in os.listdir(folder) if f.startswith("test-")])
    found = {r.sample_id: r.predicted for r in existing_predictions(test, path).collect()}
    assert found == {i: f'BIASED {i}, "SO"\nBAD' for i in range(20, 40) if i % 4}
    later = eval_model(pairs, folder + "x", "m/3", None, lambda row: scores, "j", existing=path, sizes=sizes).collect()
    assert "test_dataset_size" not in {r.key for r in later} and calls(made) == 30


def test_steps_follow_their_inputs(spark, folder):
    made = []

    def make(name, n):
        def run():
            made.append(name)
            return spark.range(n)

        return run

    for settings, expected in (({"a": 1}, ["x", "y", "z"]), ({"a": 1}, []), ({"a": 2}, ["x", "y"])):
        made.clear()
        run = Run(spark, folder)
        assert run.step("x", make("x", 3), settings).count() == 3
        assert run.step("y", make("y", 0), needs=["x"]).columns == ["id"]
        run.effect("z", lambda: made.append("z"))
        assert made == expected


def test_settings_once_a_run(spark):
    rows = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.7), ("b", 0, 0.1)], "name string, epoch int, f1 double")
    got = logs.metrics_long(rows, F.col("name"), {"p": "1"}, {}, ["f1"], F.col("epoch")).collect()
    assert sorted((r.run, r.kind, -1 if r.step is None else r.step) for r in got) == [
        ("a", "metric", 0), ("a", "metric", 1), ("a", "param", -1), ("b", "metric", 0), ("b", "param", -1)
    ]
