"""Decoding, and how chunks of giant documents are dealt out."""

import random
import time

import pyarrow as pa
import pytest
import sentencepiece

from creditloom.llm import sentencepiece_codec


@pytest.fixture(scope="module")
def codec():
    with open(sentencepiece_codec.MODEL, "rb") as f:
        return sentencepiece_codec.Codec(f.read())


def test_texts_are_those_of_the_library(codec):
    """Any ids: every piece at both places, bytes that are no UTF-8, control ids, nulls."""
    rng, n = random.Random(2), codec.model.vocab_size()
    lists = [[i] for i in range(n)] + [[i, i] for i in range(n)]
    for share in (0, 0.6):
        for _ in range(5000):
            lists.append(
                [
                    rng.choice(codec.byte_ids) if rng.random() < share else rng.randrange(n)
                    for _ in range(rng.randrange(6))
                ]
            )
    lists += [[], None, [1, 2]]
    ids = pa.array(lists, pa.list_(pa.int32()))
    texts = codec.model.decode([x or [] for x in lists])
    assert codec.decode(ids) == texts
    assert codec.decode(ids[7:9]) == texts[7:9]
    assert codec.decode(ids[:0]) == []


def test_decoding_takes_less_time_than_the_library(codec):
    ids = pa.array([codec.model.encode("some words\tof a text " * 200)] * 300, pa.list_(pa.int32()))
    codec.decode(ids[:1])
    start = time.process_time()
    texts = codec.decode(ids)
    mine = time.process_time() - start
    start = time.process_time()
    assert texts == codec.model.decode(ids.to_pylist())
    assert 3 * mine < time.process_time() - start


def test_chunks_of_a_giant_are_many_tasks(spark, monkeypatch):
    """Their tables are small, so that adaptive execution made them one partition."""
    staged = {}

    def stage(df, name):
        staged[name] = df
        return kept(df, name)

    kept = sentencepiece_codec.stage
    monkeypatch.setattr(sentencepiece_codec, "stage", stage)
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(4000))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    rows = sentencepiece_codec.encode(docs, giant=1000, chunk=500).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    assert {r.doc_id: list(r.ids) for r in rows} == {
        i: model.encode(t) for i, t in ((1, text), (2, "short"), (3, ""))
    }
    assert staged["matrices"].rdd.getNumPartitions() > 1
