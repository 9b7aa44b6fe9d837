"""The pipeline's stages: rows that share an id, extra columns with any name, and each stage against a plain version."""

import re

import numpy as np
import pytest

import corpus_pipeline
from tandem.llm import exact, minhash, mixing, toxicity
from tandem.llm.queries import vocabulary
from tandem.llm.tables import unused
from tandem.session import stage

SF_DIR = "/root/testdata/sf0.001"
CLASHING = (
    "_gone_id string, _gone_sha long, _GONE_NAME string, _mix_id string, _mix_hash long, _mix_copies string, _mix_copy long, "
    "_toxic_score double, _number long, _name string, set_name string, keep_id long, kept string, text_sha256 string, "
    "group_size long, _names string, size long, _key long, label string, band long, copies string, text_hash string, component long, a long, b long"
)
WORDS = [f"w{i}" for i in range(300)]


def sentence(start: int, n: int = 40) -> str:
    return " ".join(WORDS[start : start + n])


ROWS = [
    (3, sentence(0), "en", "s"),
    (7, sentence(0), "en", "s"),  # a copy of 3
    (7, sentence(100, 42), "en", "t"),  # the same id, a text of its own
    (7, sentence(100, 40) + " another", "en", "t"),  # near to that one
    (2, sentence(200), "fr", "t"),
    (2, sentence(200), "fr", "t"),
    (None, sentence(0), None, None),
    (9, None, "en", "u"),
    (10, "", "en", "u"),
    (11, "  ", "en", "u"),
    (12, sentence(0, 39) + " other", "en", "u"),
]


def wide(spark, rows=ROWS):
    names = [c.split()[0] for c in CLASHING.split(", ")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
    return spark.createDataFrame([(*row, 1, *([None] * len(names))) for row in rows], schema), schema


def plain_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def shingles(text):
    words = plain_words(text)
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_near(rows, percent=85):
    """The rows that stay: of linked (id, text) documents the least; rows without an id stay."""
    documents = sorted({(i, t or "") for i, t, *_ in rows if i is not None}, key=lambda d: d[0])
    sets = [shingles(t) for _, t in documents]
    label = list(range(len(documents)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    least = {}
    for at, x in enumerate(label):
        least.setdefault(x, []).append(documents[at])
    # of documents of the least id the one that stays is left open; one of each component does
    return [sorted(own) for own in least.values()]


def test_rows_that_share_an_id(spark):
    docs, _ = wide(spark)
    kept = [(r.doc_id, r.text or "") for r in minhash.without_near_duplicates(docs).collect()]
    groups = plain_near(ROWS)
    assert (None, sentence(0)) in kept
    for own in groups:
        stays = {row for row in kept if row in own}
        assert len(stays) == 1 and next(iter(stays))[0] == own[0][0]
    rows = minhash.near_duplicates(docs).collect()  # by id: one node, tied by its texts
    assert {r.component_id for r in rows if r.doc_id in (3, 7, 12)} == {3}


@pytest.mark.parametrize("name", ["exact", "near", "mix", "toxic"])
def test_columns_of_any_name_pass_through(spark, name):
    docs, schema = wide(spark)
    if name == "exact":
        out = exact.without_duplicates(docs)
        stay = sorted((r.doc_id or 0, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in out.collect())
        best = {}
        for i, t, *_ in ROWS:
            if i is not None:
                t = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
                best[t] = min(i, best.get(t, i))
        assert stay == sorted((i, t) for t, i in best.items())
    elif name == "near":
        out = minhash.without_near_duplicates(docs)
    elif name == "mix":
        chosen = stage(mixing.mix(docs), "mix")
        out = mixing.mixed_documents(docs, chosen)
        want = {}
        for r in chosen.collect():
            want[(r.doc_id, r.size)] = r.copies
        got = {}
        for r in out.collect():
            key = (r.doc_id, len(plain_words(r.text)))
            got[key] = got.get(key, 0) + 1
        times = {}
        for i, t, *_ in ROWS:
            key = (i, len(plain_words(t)))
            times[key] = times.get(key, 0) + 1
        assert got == {k: want[k] * times[k] for k in times if want[k]}
    else:
        out = corpus_pipeline.drop_toxic(spark, docs, SF_DIR)
        assert out.count() == len(ROWS)
    assert out.columns == docs.columns
    empty = spark.createDataFrame([], schema)
    assert {"exact": exact.without_duplicates, "near": minhash.without_near_duplicates}.get(name, lambda d: d)(empty).count() == 0


def test_unused_names(spark):
    assert unused(spark.createDataFrame([], "A long, a_ long"), "a", "b", "b") == ["a__", "b", "b_"]


def test_every_stage_against_its_plain_version(spark):
    """The registered pipeline, stage by stage, each judged on what the one before kept."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    given, outputs = docs, []
    for label, apply in corpus_pipeline.STAGES:
        given = stage(apply(spark, given, SF_DIR), f"test-{label}")
        outputs.append([r.asDict() for r in given.collect()])
    start = [(r.doc_id, r.text) for r in docs.collect()]
    # toxicity: the model's score of each text, summed in plain Python
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    keep = {i for i, t in start if sum((weight.get(c, 0.0) for c in set(toxicity.codes(t or "").tolist())), model.constant) < 0}
    assert {r["doc_id"] for r in outputs[0]} == keep
    # exact copies, then near ones
    best = {}
    for r in outputs[0]:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        best[text] = min(r["doc_id"], best.get(text, r["doc_id"]))
    assert {r["doc_id"] for r in outputs[1]} == set(best.values())
    near = plain_near([(r["doc_id"], r["text"]) for r in outputs[1]])
    assert {r["doc_id"] for r in outputs[2]} == {own[0][0] for own in near}
    # the mix: whole documents, at most twice, each source near its target
    sizes, taken = {}, {}
    for r in outputs[2]:
        sizes.setdefault(r["source"], []).append(len(plain_words(r["text"])))
    for r in outputs[3]:
        taken[r["source"]] = taken.get(r["source"], 0) + len(plain_words(r["text"]))
    times = {}
    for r in outputs[3]:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 2 and set(times) <= {r["doc_id"] for r in outputs[2]}
    totals = {s: sum(n) for s, n in sizes.items()}
    order = sorted(totals)
    targets = mixing.capped_targets([totals[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(totals.values()), 2)
    for source, target in zip(order, targets, strict=True):
        assert abs(taken.get(source, 0) - target) <= max(sizes[source])
    # the packing: every id of every document in one piece, sequences gapless
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces = outputs[4]
    assert sum(p["length"] for p in pieces) == sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in outputs[3])
    filled: dict[int, list] = {}
    for p in pieces:
        filled.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in filled.values():
        own.sort()
        ends = np.cumsum([n for _, n in own])
        assert [o for o, _ in own] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
