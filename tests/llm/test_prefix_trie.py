"""Prefix trie of rebuilt conversations against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import functions as F

from creditloom.llm import prefix_trie as pt
from creditloom.llm import queries, scans

FULL = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows, head=lambda c: zlib.crc32(str(c).encode()) % 6):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [r[3:] for r in sorted(x)] for c, x in own.items()}
    bases = {c: c - int(abs(c) % 100) * (1 if c >= 0 else -1) for c in turns}
    return {c: turns.get(bases[c], [])[: head(c)] + turns[c][head(c) :] for c in turns}


def plain_trie(rows):
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in sorted(rebuilt(rows).items()):
        ends[tuple(turns)].append(conv)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    saved, leaves, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, convs in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1]) if path else 0
            leaves[path[:d]] += not children[path]
    return sorted(
        (
            convs[0],
            len(path),
            members[path[:-1]][0] if path else -1,
            len(convs),
            children[path],
            leaves[path],
            saved[path],
            hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest(),
        )
        for path, convs in members.items()
    )


def found(df):
    rows = [tuple(r)[:8] for r in df.collect()]
    return sorted((c, d, -1 if p is None else p, *rest) for c, d, p, *rest in rows)


def test_query(spark, sf):
    rows = duckdb.connect().execute(f"from '{sf}/conversations.parquet'").fetchall()
    df = queries.queries()["op13_prefix_trie"](spark, sf)
    assert df.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        "ends_sha256",
    ]
    assert {t for _, t in df.dtypes} == {"bigint", "string"}
    assert found(df) == plain_trie(rows)


def random_rows(rng, ids, longest):
    rows = []
    for conv in ids:
        copies = rng.choice([1, 1, 2])
        for turn in range(rng.randint(1, longest)):
            turn = rng.choice([turn, turn, turn, None])
            role = rng.choice(["user", "assistant", None, ""])
            rows += [(conv, turn, role, rng.choice(["a", "bb", "", None, "𝄞é"]))] * copies
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, seed):
    """Nulls, ties, repeated rows, missing bases, negative ids, clashing names."""
    rng = random.Random(seed)
    ids = [None, *rng.sample([*range(-250, 0), *range(120, 200), *range(500, 530)], 160), 2**40]
    rows = random_rows(rng, ids, 9)
    df = spark.createDataFrame(
        [(*r, "c", "c", "c") for r in rows], f"{FULL}, digest string, n_convs string, `a.b` string"
    )
    assert found(pt.prefix_trie(df)) == plain_trie(rows)


def test_no_rows(spark):
    none = spark.createDataFrame([], FULL)
    assert pt.prefix_trie(none).count() == 0
    null = spark.createDataFrame([(None, 1, "user", "x")], FULL)
    assert pt.prefix_trie(null).count() == 0


def test_nested_copies_and_a_long_conversation(spark, conf):
    """Each conversation continues the one before, so chains hang on chains; one is very long."""
    conf(shuffle__partitions="11")
    def text(t):
        return f"turn {t}" if t != 3 else "long " * 100_000
    rows = [(100 * c, t, "user", text(t)) for c in range(40) for t in range(c + 1)]
    rows += [(100 * c, t, "user", "copy") for c in range(40, 90) for t in range(3)]
    rows += [(9900, t, "user" if t % 2 else "assistant", f"x{t % 7}") for t in range(1500)]
    assert found(pt.prefix_trie(spark.createDataFrame(rows, FULL))) == plain_trie(rows)


def test_colliding_fingerprints_are_noticed(spark):
    rows = [(c * 100, t, "user", f"{c % 3} {t} {c}") for c in range(60) for t in range(4)]
    df = spark.createDataFrame(rows, FULL)
    small = pt.Key(13, 5)
    with pytest.raises(RuntimeError):
        pt.prefix_trie(df, keys=[small])
    assert found(pt.prefix_trie(df, keys=[small, pt.KEYS[0]])) == plain_trie(rows)


def test_references_hold_the_last_text(spark):
    rows = [(c * 100 + c % 2, t, "user", f"{c % 2} {t}") for c in range(6) for t in range(3)]
    df = spark.createDataFrame(rows, FULL)
    nodes = pt.prefix_trie(df, base=F.col("conv_id") - F.col("conv_id") % 100, head=F.lit(1))
    held = defaultdict(list)
    for conv, _, _, text in rows:
        held[conv].append(text)
    paths = rebuilt(rows, head=lambda c: 1)
    for r in nodes.where("depth > 0").collect():
        assert held[r.ref_conv_id][r.ref_turn - 1] == paths[r.conv_id][r.depth - 1][1]


def test_monoid():
    key, rng = pt.KEYS[1], random.Random(8)
    digests = [rng.randbytes(32) for _ in range(30)]
    whole = (0, *key.split(0))
    for d in digests:
        whole = key.combine(whole, key.element(d))
    for cut in range(31):
        parts = [(0, *key.split(0)), (0, *key.split(0))]
        for n, d in enumerate(digests):
            parts[n >= cut] = key.combine(parts[n >= cut], key.element(d))
        assert key.combine(*parts) == whole
    assert key.join(*key.split(key.modulus - 1)) == key.modulus - 1


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_running_products(spark, conf, partitions):
    conf(shuffle__partitions=partitions)
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, 1, 1, 1, 2, *range(30)]), i, i % 5) for i in range(600)]
    df = spark.createDataFrame(rows, "g bigint, i bigint, x bigint")
    out = scans.running_products(
        df, "g", ["i"], ["x"], ["n", "s"], lambda x: (1, x),
        lambda a, b: (a[0] + b[0], a[1] + b[1]), "test",
    )
    want = []
    for g, group in groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), key=lambda r: r[0]):
        n = s = 0
        for _, i, x in group:
            n, s = n + 1, s + x
            want.append((g, i, x, n, s))
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])
