"""Word-by-word encoding in batches against the library's encoding of whole texts."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tandem.llm import minhash, mixing, packing, token_ids, training_order, words
from tandem.llm.queries import vocabulary

SIGNS = [*"aAbBzZ019.,!?;:'\"-_()<|>#@", "é", "É", "ß", "İ", "ﬁ", "中", "é", "​", "\x01", "\xa0", "😀"]
SIGNS += ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "\t", "\n", "\x0b", "  "]


@pytest.mark.parametrize("cache", [50, 800_000])
def test_batches_equal_whole_texts(monkeypatch, cache):
    monkeypatch.setattr(token_ids.words, "CACHE_WORDS", cache)
    path = vocabulary("word_bpe_49k.json")
    tokenizer, encoder, rng = Tokenizer.from_file(path), token_ids.WordEncoder(path), random.Random(cache)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(25))) for _ in range(60_000)]
    wanted = [own.ids for own in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 3000):
        ids, sizes = encoder.encode_all(pa.array(texts[at : at + 3000]), 2)
        got = np.split(ids, np.cumsum(sizes)[:-1])
        assert [own.tolist() for own in got] == [[*own, 2] for own in wanted[at : at + 3000]]
    ids, sizes = encoder.encode_all(pa.array([None, "", "A b."], pa.string()))
    assert sizes.tolist()[:2] == [0, 0] and ids.tolist() == tokenizer.encode("A b.", add_special_tokens=False).ids


def test_wide_vocabulary_is_refused(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(Exception, match="16 bits"):
        training_order.materialise(docs, vocabulary("word_bpe_49k.json"), end_id=70_000)


def test_a_worker_keeps_no_tables_of_other_operators():
    minhash.shingles(b"a b c d e f")
    list(words.slices(iter([]), table="shingle words"))
    assert len(minhash._HASHES) == 6
    list(words.pieces(iter([]), table=token_ids.TABLE))
    assert len(minhash._HASHES) == 0


def test_the_pipeline_packs_with_few_words_in_memory_and_the_same_ids(monkeypatch):
    given = {}
    monkeypatch.setattr(packing, "pack", lambda docs, path, **more: given.update(more))
    corpus_pipeline.pack(SimpleNamespace(conf=SimpleNamespace(set=lambda *_: None)), None, "")
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    path = vocabulary("word_bpe_49k.json")
    texts = [" ".join(f"q{k}x" for k in range(at, at + 1000)) for at in range(0, 300_000, 1000)]
    # words met long ago come again
    batch = pa.RecordBatch.from_arrays([pa.array(range(301)), pa.array([*texts, texts[0]])], ["doc_id", "text"])
    rows, kept = [], []
    for own in (given, {}):
        monkeypatch.setattr(token_ids, "_ENCODERS", {})
        run = packing._filled(4096, path, 2, True, own.get("piece", 4 << 20), own.get("known_words"))
        rows.append([row for made in run(iter([batch])) for row in made.to_pylist()])
        encoder = token_ids.word_encoder(path)
        kept.append(len(encoder.known.number) + len(encoder.older.number))
    assert rows[0] == rows[1]
    assert kept[0] < 250_000 < kept[1]


def test_the_plan_of_a_mix_is_made_without_python_workers(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "c", None)], "doc_id long, text string, source string")
    chosen = mixing.mix(docs.repartition(1))
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan
    assert [tuple(r) for r in chosen.orderBy("doc_id").select("doc_id", "size", "source_size").collect()] == [(1, 2, 2), (2, 1, 1)]
