import math
import random
import re
from collections import Counter

import pytest

from creditloom.operators import term_index as ti


def brute(passages, questions, k):
    words = lambda t: Counter(re.findall(r"[a-z0-9]+", (t or "").lower()))
    docs = {i: words(t) for i, t in passages}
    n = Counter(w for d in docs.values() for w in d)
    rare = lambda w: math.log((len(docs) + 1) / (n[w] + 1))

    def unit(counts):
        v = {w: c * rare(w) for w, c in counts.items()}
        length = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / length for w, x in v.items()}

    units, out = {i: unit(d) for i, d in docs.items()}, {}
    for q, text in questions:
        mine = unit(words(text))
        far = {i: 1 - sum(x * u.get(w, 0) for w, x in mine.items()) for i, u in units.items()}
        best = sorted(far, key=lambda i: (round(far[i], 6), i))[:k]
        out[q] = [(i, round(far[i], 6)) for i in best]
    return out


def run(spark, passages, questions, k):
    docs = spark.createDataFrame(passages, "id bigint, text string").repartition(3)
    asked = spark.createDataFrame(questions, "id string, text string")
    index = ti.build_index(ti.counted(docs))
    hits, work = ti.search(index, ti.counted(asked), k)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.distance, 6)))
    return got, work


def zipf_text(rng, size, vocabulary=3000):
    return " ".join(f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(size))


@pytest.mark.parametrize("block", [8, 128])
def test_same_as_the_full_product(spark, monkeypatch, block):
    monkeypatch.setattr(ti, "BLOCK", block)
    rng = random.Random(2)
    passages = [(i, zipf_text(rng, rng.randint(3, 60))) for i in range(600)]
    passages += [(600 + i, passages[7][1]) for i in range(300)]  # a third are copies
    questions = [(f"q{i}", zipf_text(rng, rng.randint(1, 30))) for i in range(25)]
    questions += [("copy", passages[7][1]), ("none", "unheard of"), ("empty", ""), ("null", None)]
    got, _ = run(spark, passages, questions, 5)
    assert got == brute(passages, questions, 5)


def test_blocks_of_other_subjects_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(ti, "BLOCK", 20)
    rng = random.Random(9)

    def text(subject, size):
        own = [f"s{subject}x{int(40 * rng.random() ** 2)}" for _ in range(size)]
        return " ".join([*own, "the", "of"])

    passages = [(i, text(i % 30, 25)) for i in range(900)]
    questions = [(f"q{i}", text(i, 6)) for i in range(30)]
    got, work = run(spark, passages, questions, 5)
    assert got == brute(passages, questions, 5)
    done = work.groupBy().sum("blocks", "visited").first()
    assert done["sum(blocks)"] == 30 * 45 and done["sum(visited)"] < 30 * 45 / 10


def test_frequent_terms_alone(spark):
    """Every passage has the words of the question; none is rare."""
    rng = random.Random(3)
    passages = [(i, " ".join(rng.choices("abcdef", k=rng.randint(1, 12)))) for i in range(400)]
    questions = [("x", "a b"), ("y", "f f f a"), ("z", "c")]
    got, _ = run(spark, passages, questions, 7)
    assert got == brute(passages, questions, 7)


def test_few_passages(spark):
    passages = [(1, "one"), (2, None), (3, "")]
    questions = [("q", "one two"), ("r", "three")]
    assert run(spark, passages, questions, 5)[0] == brute(passages, questions, 5)
    assert run(spark, passages[:0], questions, 5)[0] == {}
    assert run(spark, passages, questions[:0], 5)[0] == {}


def test_frequencies_change_with_passages(spark):
    rng = random.Random(4)
    rows = [(i, zipf_text(rng, 20, 50)) for i in range(60)]
    counts = ti.counted(spark.createDataFrame(rows, "id bigint, text string")).persist()
    old, added, removed = (counts.where(f"id between {lo} and {hi}") for lo, hi in ((0, 39), (40, 59), (0, 9)))
    merged = ti.merged_frequencies(*(ti.frequencies(x) for x in (old, added, removed)))
    want = ti.frequencies(counts.where("id >= 10"))
    assert sorted(merged.collect()) == sorted(want.collect())
    counts.unpersist()


def test_what_is_written_does_not_grow_with_the_blocks(spark, monkeypatch):
    """Questions are told about groups of blocks; groups and parts of any size give the same hits."""
    for name, size in (("BLOCK", 8), ("GROUPS", 3), ("GROUP_BLOCKS", 9), ("GROUP_QUERIES", 7), ("BLOCK_QUERIES", 3)):
        monkeypatch.setattr(ti, name, size)
    written, write = {}, ti.write_stage
    monkeypatch.setattr(ti, "write_stage", lambda df, name: written.setdefault(name, write(df, name)))
    rng = random.Random(5)
    passages = [(i, zipf_text(rng, rng.randint(3, 60))) for i in range(400)]
    questions = [(f"q{i}", zipf_text(rng, rng.randint(1, 30))) for i in range(20)]
    index = ti.build_index(ti.counted(spark.createDataFrame(passages, "id bigint, text string")))
    asked = ti.counted(spark.createDataFrame(questions, "id string, text string"))
    hits, work = ti.search(index, asked, 5)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.distance, 6)))
    assert got == brute(passages, questions, 5)
    blocks, groups = 50, 6
    assert work.groupBy().sum("blocks").first()[0] > 20 * blocks / 2
    assert written["bounds"].count() <= 20 * groups and written["visits"].count() <= 20 * groups


def test_terms_that_are_not_at_hand_count_too(spark, monkeypatch):
    """Numbers of passages of rare terms are joined; a few frequent ones are sent to the tasks."""
    rng = random.Random(6)
    passages = [(i, zipf_text(rng, rng.randint(3, 40))) for i in range(200)]
    questions = [(f"q{i}", zipf_text(rng, rng.randint(1, 20))) for i in range(10)]
    for frequent in (0, 7):
        monkeypatch.setattr(ti, "FREQUENT", frequent)
        assert run(spark, passages, questions, 5)[0] == brute(passages, questions, 5)


def test_frequent_terms_bring_no_passages(spark, monkeypatch):
    """A group is one row, is not shuffled for questions, and only what may reach the floor is looked at."""
    rng = random.Random(7)
    common = [f"c{i}" for i in range(12)]
    passages = [(i, " ".join([*rng.sample(common, 9), f"r{i % 400}", f"s{i % 300}"])) for i in range(1200)]
    docs = spark.createDataFrame(passages, "id bigint, text string")
    asked = spark.createDataFrame([("q", "c1 c2 c3 c4 c5 r17 s17")], "id string, text string")
    index = ti.build_index(ti.counted(docs))
    assert index.packs.count() == 2
    questions = ti._weighted(ti.counted(asked), index.freq, index.passages)
    floored = ti._question_packs(questions.selectExpr("*", "0.4D as floor"), "floored")
    crossed = index.packs.crossJoin(floored)
    assert "hashpartitioning" not in crossed._jdf.queryExecution().executedPlan().toString()
    summed, sums = [], ti._Pack.sums

    def counted(pack, row, term, w, visits):
        summed.append(int(pack.sizes[term].sum()))
        return sums(pack, row, term, w, visits)

    monkeypatch.setattr(ti._Pack, "sums", counted)
    kinds = "query_id string, id bigint, score double, visited bigint"
    schema = ti.to_arrow_schema(spark.createDataFrame([], kinds).schema)
    batches = crossed.toArrow().to_batches(max_chunksize=1)
    found = [x for b in ti._group_product(5, schema)(iter(batches)) for x in b.to_pylist()]
    want = brute(passages, [("q", "c1 c2 c3 c4 c5 r17 s17")], 5)["q"]
    got = sorted((round(1 - x["score"], 6), x["id"]) for x in found if x["id"] is not None)[:5]
    assert got == [(d, i) for i, d in want if 1 - d >= 0.4]
    assert sum(summed) < 20
