"""Blocks of words that a later text shares with an earlier one."""

import random
import time

import numpy as np
import pyarrow as pa

from creditloom.llm import line_dedup
from creditloom.llm.line_dedup import shared_blocks


def windows(words, size):
    return [hash(tuple(words[i : i + size])) for i in range(len(words) - size + 1)]


def test_blocks_in_reverse_order_take_no_time():
    words = [f"w{i}" for i in range(9600)]
    reverse = [x for i in range(9540, -1, -60) for x in words[i : i + 60]]
    a, b = windows(words, 8), windows(reverse, 8)
    start = time.perf_counter()
    blocks = shared_blocks(a, b, 8, 50)
    assert time.perf_counter() - start < 0.3
    assert blocks == [(i, i + 60) for i in range(0, 9600, 60)]


def test_blocks_against_all_runs():
    """Only words in shared runs go, and no shared run is left, whatever overlaps and repeats."""
    rng, least = random.Random(3), 6
    for _ in range(1500):
        kinds = rng.choice([3, 5, 30])
        a = [rng.randrange(kinds) for _ in range(rng.randrange(60))]
        b = []
        while len(b) < rng.randrange(1, 60):
            if a and rng.random() < 0.5:
                i = rng.randrange(len(a))
                b += a[i : i + rng.randrange(1, 20)]
            else:
                b.append(rng.randrange(kinds + 5))
        runs = {tuple(a[i : i + least]) for i in range(len(a) - least + 1)}
        shared = {
            k for i in range(len(b) - least + 1) if tuple(b[i : i + least]) in runs for k in range(i, i + least)
        }
        gone = {k for s, e in shared_blocks(windows(a, 2), windows(b, 2), 2, least) for k in range(s, e)}
        assert gone <= shared
        rest = [x if k not in gone else None for k, x in enumerate(b)]
        assert not any(tuple(rest[i : i + least]) in runs for i in range(len(rest) - least + 1))


def test_many_pairs_take_little_time():
    """Copies, near copies and texts with one shared passage, as they are aligned in a task."""
    rng = np.random.default_rng(5)
    pairs = []
    for k in range(900):
        a = rng.integers(-(2**31), 2**31, 800).astype(np.int32)
        b = a.copy()
        if k % 3 == 1:
            b[400] += 1
        elif k % 3 == 2:
            b = rng.integers(-(2**31), 2**31, 800).astype(np.int32)
            b[100:200] = a[300:400]
        pairs.append((a, b))
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(range(900)),
            pa.array(range(900)),
            pa.array([a for a, _ in pairs], pa.list_(pa.int32())),
            pa.array([b for _, b in pairs], pa.list_(pa.int32())),
        ],
        names=["id", "t", "earlier", "later"],
    )
    align = line_dedup._aligner(8, 20, 50)
    start = time.process_time()
    rows = [x for out in align(iter([batch])) for x in out.to_pylist()]
    mine = time.process_time() - start
    whole, two, one = ([x["blocks"] for x in rows[k::3]] for k in range(3))
    assert all(x == [{"start": 0, "end": 807}] for x in whole)
    assert all(x == [{"start": 0, "end": 407}, {"start": 401, "end": 807}] for x in two)
    assert all(x == [{"start": 100, "end": 207}] for x in one)
    # sorting the hashes of the runs of a pair four times is the measure
    start = time.process_time()
    for a, b in pairs:
        for _ in range(4):
            np.argsort(np.concatenate([a, b]), kind="stable")
    assert mine < 2 * (time.process_time() - start)


def test_hashes_of_runs():
    """A polynomial modulo 2**64 of each run, for all lengths."""
    rng = random.Random(6)
    h = [rng.randrange(2**64) for _ in range(70)]
    for run in (1, 2, 13, 43, 70, 71):
        plain = []
        for i in range(len(h) - run + 1):
            x = 0
            for y in h[i : i + run]:
                x = (x * line_dedup.BASE + y) % 2**64
            plain.append((x ^ x >> 31) * 0xD6E8FEB86659FD93 % 2**64)
        assert line_dedup.rolling(np.array(h, dtype=np.uint64), run).tolist() == plain
