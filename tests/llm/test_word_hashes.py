"""Hashes of words and windows, and what the line dedup makes of them."""

import random
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from creditloom.llm import line_dedup, word_hashes
from creditloom.llm.common import WHITE_SPACE, words


def texts(rng, n):
    letters = "ab\t \n\x0b\x0c\r\x08\x0e\x1f\x85\xa0é本\U0001f600\x00"
    rows = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(n)]
    long = " ".join("".join(rng.choices("abé", k=k)) for k in range(1, 100))
    return [*rows, "", " ", long, "z" * 1001, ""]


def test_words_and_windows_as_the_built_in_functions_hash_them(spark, monkeypatch):
    rows = texts(random.Random(2), 300)
    docs = spark.createDataFrame(list(enumerate(rows)), "i bigint, text string")
    broken = spark.createDataFrame(
        [(1000, b"a\xe4 b\xff\xfe c"), (1001, b"\xf0\x9f a\x80\nd"), (1002, None)], "i bigint, b binary"
    ).select("i", F.col("b").cast("string").alias("text"))
    docs = docs.union(broken).select("i", "text", words(F.col("text"), WHITE_SPACE).alias("w"))
    hashes = F.transform("w", lambda x: F.xxhash64(x))
    want = docs.select("i", line_dedup._plain(F.col("text")).alias("text"), hashes.alias("h")).orderBy("i").toArrow()
    column = want.column("text").combine_chunks()
    for part in (1, 100, 1 << 20):
        monkeypatch.setattr(word_hashes, "PART", part)
        for first in (0, 5):
            got = [
                h[i:j].view(np.int64).tolist()
                for h, ends in word_hashes.hashed_words(column.slice(first))
                for i, j in zip(ends[:-1], ends[1:])
            ]
            assert got == want.column("h").to_pylist()[first:]
    numbers = [x for row in want.column("h").to_pylist() for x in row][:200]
    eights = [numbers[i : i + 8] for i in range(len(numbers) - 7)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(eights)], "i int, x array<bigint>")
    plain = [r[0] for r in frame.orderBy("i").select(F.hash(*[F.col("x")[k] for k in range(8)])).collect()]
    array = np.array(numbers, dtype=np.int64).view(np.uint64)
    assert word_hashes.murmur3(array, 8).tolist() == plain
    assert word_hashes.murmur3(array[:7], 8).size == 0


def batch_of(rows):
    n = pa.array(range(len(rows)))
    return pa.RecordBatch.from_arrays([n, n, pa.array(rows)], names=["id", "t", "text"])


def test_texts_of_a_batch_are_kept_apart(monkeypatch):
    """The runs and windows of texts that are hashed together are those of each text alone."""
    rng = random.Random(4)
    rows = [" ".join(rng.choices("abc", k=rng.choice([0, 1, 7, 8, 49, 50, 51, 90]))) for _ in range(60)]
    for part in (1, 300, 1 << 20):
        monkeypatch.setattr(word_hashes, "PART", part)
        kept = [x for out in line_dedup._winnower(20, 50)(iter([batch_of(rows)])) for x in out.to_pylist()]
        cut = [x for out in line_dedup._windower(8)(iter([batch_of(rows)])) for x in out.to_pylist()]
        assert [x["id"] for x in cut] == list(range(len(rows)))
        for i, row in enumerate(rows):
            (hashes, _), = word_hashes.hashed_words(pa.array([row]))
            mine = [x["run"] for x in kept if x["id"] == i]
            assert mine == line_dedup.winnowed(hashes, 20, 50).tolist()
            assert cut[i]["windows"] == word_hashes.murmur3(hashes, 8).tolist()


def test_a_missed_block_is_sent_once_for_a_document():
    rng = np.random.default_rng(8)
    later = rng.integers(-(2**31), 2**31, 300).astype(np.int32)
    others = [np.concatenate([rng.integers(-(2**31), 2**31, 90).astype(np.int32), later[a : a + 30]]) for a in (50, 50, 200)]
    columns = [pa.array(["x", "x", "x", "y", None]), pa.array([1] * 5)]
    pairs = [*others, others[0], others[0]]
    columns += [pa.array(pairs, pa.list_(pa.int32())), pa.array([later] * 5, pa.list_(pa.int32()))]
    batch = pa.RecordBatch.from_arrays(columns, names=["id", "t", "earlier", "later"])
    (out,) = line_dedup._aligner(8, 20, 50)(iter([batch]))
    missed = [set(x) for x in out.column("missed").to_pylist()]
    assert missed[0] and missed[2] and not missed[1] and not missed[0] & missed[2]
    assert missed[3] == missed[4] == missed[0]  # other documents have their own


def test_hashing_texts_takes_little_time():
    rng = random.Random(6)
    kinds = ["".join(rng.choices("abcdefghij", k=rng.randrange(1, 14))) for _ in range(3000)]
    rows = [" ".join(rng.choices(kinds, k=500)) for _ in range(1000)]
    batch = batch_of(rows)
    start = time.process_time()
    for task in (line_dedup._winnower(20, 50), line_dedup._windower(8)):
        for _ in task(iter([batch])):
            pass
    mine = time.process_time() - start
    # cutting the words out one by one is the measure
    start = time.process_time()
    for row in rows:
        list(map(str.encode, re.split(r"[\x20\x09-\x0D]+", row)))
    assert mine < 3 * (time.process_time() - start)
