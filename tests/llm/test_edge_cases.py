"""Every operator and stage on nulls, empty and long texts, copies, clashing columns, no rows."""

from collections import Counter

import brute
import numpy as np
import pytest
from edge import CLASHING, EDGE_ROWS, LONG, PROSE
from pyspark.sql import functions as F

import corpus_pipeline
from creditloom.llm import (
    decontamination,
    html_extraction,
    licenses,
    line_dedup,
    quality,
    secret_scan,
    sentencepiece_codec,
    simhash,
    toxicity,
    warc,
)
from creditloom.llm.components import connected_components

IDS = Counter(i for i, _ in EDGE_ROWS)


@pytest.fixture
def edge_docs(spark):
    rows = [(i, x, *["c"] * 7) for i, x in EDGE_ROWS]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, {CLASHING}")


@pytest.fixture
def no_docs(edge_docs):
    return edge_docs.limit(0)


def ids_of(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string, d string")


ITEMS = [(1, PROSE, ""), (2, " ".join(PROSE.split()[:5]), ""), (3, None, ""), (4, "", ""), (None, PROSE, "")]


def test_licenses(spark, edge_docs, no_docs):
    noted = edge_docs.withColumn("text", F.concat("text", F.lit("\nReleased under the MIT License.")))
    found = licenses.find_licenses(noted).collect()
    assert {r.license for r in found} == {"mit"}
    want = {(i, x) for i, x in EDGE_ROWS if x is not None}
    assert len(found) == len(want) and all(r.containment == 1 for r in found)
    assert licenses.find_licenses(no_docs).count() == 0
    none = spark.createDataFrame([], "license string, text string")
    assert licenses.find_licenses(noted, none).count() == 0
    odd = spark.createDataFrame([(None, PROSE), ("empty", ""), ("null", None)], "license string, text string")
    assert licenses.find_licenses(noted, odd).count() == 0


def test_quality(edge_docs, no_docs):
    rows = quality.apply_rules(edge_docs).collect()
    got = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in rows
    )
    assert got == Counter((i, *brute.quality_base(x)) for i, x in EDGE_ROWS)
    assert not any(r.kept and r.base_failed for r in rows)
    assert {r.kept for r in rows if r.doc_id == 4} == {True}
    assert quality.apply_rules(no_docs).count() == 0


def test_quality_order_does_not_change_the_verdict(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = quality.default_rules(F.col("_text"))
    a, b = (
        sorted(map(tuple, quality.apply_rules(docs, rules=r).select("doc_id", "kept").collect()))
        for r in (rules, rules[::-1])
    )
    assert a == b and {k for _, k in a} == {True, False}


def test_repeated_windows(spark):
    base = " ".join(f"w{i}" for i in range(30))
    texts = [base, base + " " + base, "a " * 40, base + " x " + base[:60], "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.apply_rules(docs).collect()}
    assert got == {i: brute.quality_base(t)[4] for i, t in enumerate(texts)}


def test_line_dedup(edge_docs, no_docs):
    out = line_dedup.dedup_lines(edge_docs)
    assert out.columns == edge_docs.columns and ids_of(out) == IDS
    text = {}
    for r in out.collect():
        text.setdefault(r.doc_id, set()).add(r.text)
    assert text[4] == {PROSE} and text[5] == {""} and text[6] == {LONG} and text[7] == {""}
    assert text[None] == {None, ""} and text[2] == {None} and text[1] == {""}
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_labels_of_other_documents_do_not_use_up_the_sample(spark):
    bad, good = "awful nasty rude words here", "kind calm plain words here"
    docs = spark.createDataFrame(
        [(i * 100, f"{bad if i % 2 else good} {i}") for i in range(40)], "doc_id bigint, text string"
    )
    labels = spark.createDataFrame([(i, i // 100 % 2) for i in range(4000)], "doc_id bigint, toxic int")
    weights = toxicity.train(docs, labels, rows=200)
    assert weights.count() > 1
    scores = {r.doc_id: r.score for r in toxicity.score_texts(docs, weights).collect()}
    assert min(scores[i * 100] for i in range(1, 40, 2)) > max(scores[i * 100] for i in range(0, 40, 2))


def test_patience_diff():
    a, b = list("abcxdef"), list("zabcydefz")
    assert [(x, y) for x, y in line_dedup.patience_matches(a, b)] == [
        (0, 1), (1, 2), (2, 3), (4, 5), (5, 6), (6, 7),
    ]
    assert line_dedup.shared_blocks(a, b, 1, 3) == [(1, 4), (5, 8)]
    assert line_dedup.shared_blocks(a, b, 1, 4) == []
    assert line_dedup.shared_blocks(list("abcdef"), list("defabcxabc"), 1, 3) == [(0, 3), (3, 6), (7, 10)]
    # no line is unique on both sides
    assert line_dedup.patience_matches(list("xaax"), list("yaay")) == [(1, 1), (2, 2)]
    assert line_dedup.patience_matches([], list("ab")) == []


def test_a_long_block_behind_a_chain_of_short_ones(spark):
    w = lambda c, n: [f"{c}{i}" for i in range(n)]
    p, q, r = w("p", 6), w("q", 4), w("r", 4)
    earlier, later = p + ["x"] + q + ["y"] + r, q + ["u"] + r + ["v"] + p
    assert line_dedup.shared_blocks(earlier, later, 1, 6) == [(10, 16)]
    # stands twice in the earlier one, so that only the short piece is unique
    twice = p + ["x"] + q + ["y"] + p
    assert line_dedup.shared_blocks(twice, p + ["v"] + q, 1, 6) == [(0, 6)]
    p, q, r = (" ".join(x) for x in (w("p", 60), w("q", 40), w("r", 40)))
    rows = [(1, f"{p} x y {q} z {r}"), (2, f"{q} u {r} v v {p}\nend")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert dict(line_dedup.dedup_lines(docs).collect()) == {1: rows[0][1], 2: f"{q} u {r} v v end"}


def test_a_passage_around_a_shorter_one_of_an_earlier_document(spark):
    """The first document of each run of the passage has too little of it; the second has it all."""
    rows = []
    for k in range(12):
        w = lambda c, n: " ".join(f"{c}{k}_{i}" for i in range(n))  # noqa: E731, B023
        passage = w("a", 5) + " " + w("hot", 40) + " " + w("b", 6)
        rows += [(10 * k, f"{w('u', 30)} {w('hot', 40)} {w('v', 30)}"),
                 (10 * k + 1, f"{w('s', 9)} {passage} {w('t', 9)}"),
                 (10 * k + 2, f"{w('x', 7)} {passage} {w('y', 7)}"),
                 (10 * k + 3, f"{w('n', 7)} {w('hot', 40)} {w('m', 7)}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {i: x for i, x in rows}
    for k in range(12):
        w = want[10 * k + 2].split()
        want[10 * k + 2] = " ".join(w[:7] + w[-7:])
    assert dict(line_dedup.dedup_lines(docs).collect()) == want


def test_every_long_block_goes():
    """What is left has no run of the least length that the earlier one has."""
    rng = np.random.default_rng(11)
    for _ in range(300):
        a, b = (rng.integers(0, 4, rng.integers(5, 60)).tolist() for _ in "ab")
        blocks = line_dedup.shared_blocks(a, b, 1, 5)
        grams = {tuple(a[i : i + 5]) for i in range(len(a) - 4)}
        gone = {j for s, e in blocks for j in range(s, e)}
        whole = {i for j in range(len(b) - 4) if tuple(b[j : j + 5]) in grams for i in range(j, j + 5)}
        assert gone <= whole
        for j in range(len(b) - 4):
            assert tuple(b[j : j + 5]) not in grams or gone & set(range(j, j + 5))


def test_passages_inside_lines_and_out_of_order(spark):
    p, q, r = (" ".join(f"{c}{i}" for i in range(55)) for c in "pqr")
    rows = [
        (1, f"{p}\n{q}"),
        (2, f"{r}\n{q}\n"),
        (3, f"short\n{q}\n{p}"),
        (4, f"short {r} and {p} more"),
        (5, " ".join(p.split()[:49])),
        (6, f"x {p} y\t{p}\nz"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = dict(line_dedup.dedup_lines(docs).collect())
    assert got == {
        1: rows[0][1], 2: f"{r}\n", 3: "short\n", 4: "short and more", 5: rows[4][1], 6: "x y\tz",
    }


def test_winnowing_keeps_a_run_of_every_shared_passage():
    rng = np.random.default_rng(3)
    words = lambda n: rng.integers(-(2**62), 2**62, n)
    for run, least in ((20, 50), (1, 3), (5, 5), (7, 30)):
        for _ in range(40):
            p = words(least)
            a, b = (np.concatenate([words(rng.integers(0, 60)), p, words(rng.integers(0, 60))]) for _ in "ab")
            assert np.intersect1d(line_dedup.winnowed(a, run, least), line_dedup.winnowed(b, run, least)).size
        assert line_dedup.winnowed(words(least - 1), run, least).size == 0


def test_short_lines_of_a_long_block(spark):
    lines = [f"line {i} has six words here" for i in range(12)]
    rows = [(1, "\n".join(["start", *lines])), (2, "\n".join([*lines, "", "end"])), (3, lines[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert dict(line_dedup.dedup_lines(docs).collect()) == {1: rows[0][1], 2: "end", 3: lines[3]}


def test_decontamination(spark, edge_docs, no_docs):
    bench = items(spark, ITEMS)
    rows = decontamination.contaminated_words(edge_docs, bench).collect()
    want = Counter(brute.contamination(EDGE_ROWS, [x[:2] for x in ITEMS]))
    import hashlib

    got = Counter(
        (r.doc_id, r.n_words, r.n_hit, len(r.item_ids),
         hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), r.contaminated)
        for r in rows
    )
    assert got == want
    assert decontamination.contaminated_words(no_docs, bench).count() == 0
    assert not any(r.n_hit for r in decontamination.contaminated_words(edge_docs, items(spark, [])).collect())
    kept = decontamination.drop_contaminated(edge_docs, bench)
    assert kept.columns == edge_docs.columns
    assert ids_of(kept) == Counter(w[0] for w in want.elements() if not w[5])


@pytest.mark.parametrize("bench", [[(1, "b")], [(1, "a b"), (2, "b a b")], [(1, "a a a a")]])
def test_short_items_against_brute_force(spark, bench):
    docs = [(1, "a b a b"), (2, "A a, A! a a"), (3, "b"), (4, "c" * 50), (5, "a-b b.a")]
    got = decontamination.contaminated_words(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(bench, "item_id bigint, text string"),
    ).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, len(r.item_ids)) for r in got) == [
        w[:4] for w in brute.contamination(docs, bench)
    ]


def test_spans_merge(spark):
    spans = [(0, 3), (1, 2), (3, 5), (7, 8), (7, 9), (8, 12), (20, 21)]
    df = spark.createDataFrame([(spans,)], "s array<struct<start:int,end:int>>")
    got = df.select(decontamination.merged_spans(F.array_sort("s"), 4).alias("m")).first().m
    assert [tuple(x) for x in got] == [(0, 5), (7, 12), (20, 21)]


def test_simhash(edge_docs, no_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    assert Counter(r.doc_id for r in rows) == IDS
    of = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    empty = "0" * 16
    assert {of[1, empty], of[2, empty], of[3, empty], of[None, empty]} == {1}
    prose = f"{brute.fingerprint(PROSE):016x}"
    assert of[4, prose] == of[5, prose] == of[None, prose] == 4
    kept = simhash.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns
    components = {r.component_id for r in rows}
    assert ids_of(kept) == Counter(components)
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_first(no_docs).count() == 0


def test_simhash_of_null_ids_alone(spark):
    docs = spark.createDataFrame([(None, PROSE), (None, PROSE), (None, LONG)], "doc_id bigint, text string")
    assert sorted(r.text for r in simhash.keep_first(docs).collect()) == sorted([PROSE, LONG])


@pytest.mark.parametrize("group", [2, 8, 2048])
def test_hot_variants_lose_no_link(spark, group):
    """Fingerprints that crowd around few centres, cut again at a small group size."""
    rnd = np.random.default_rng(5)
    fps = {0, 1, (1 << 64) - 1}
    for centre in rnd.integers(0, 1 << 63, 4, dtype=np.uint64).tolist():
        for _ in range(30):
            bits = rnd.choice(64, rnd.integers(0, 5), replace=False)
            fps.add(centre ^ sum(1 << int(b) for b in bits))
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), group=group)
    root = {r.node: r.root for r in connected_components(links, "a", "b").collect()}
    want = {f: f for f in signed}

    def find(f):
        while want[f] != f:
            f = want[f]
        return f

    for i, f in enumerate(signed):
        for g in signed[:i]:
            if ((f ^ g) & ((1 << 64) - 1)).bit_count() <= 3:
                a, b = sorted((find(f), find(g)))
                want[b] = a
    assert {f: root.get(f, f) for f in signed} == {f: find(f) for f in signed}


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, i) for i in range(1001, 1040)]
    links = spark.createDataFrame([*chain, *star, (5, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in connected_components(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 1000 for i in range(1001, 1040)}}
    assert connected_components(links.limit(0), "a", "b").count() == 0


def test_secrets(spark, edge_docs, no_docs):
    assert ids_of(secret_scan.scan_secrets(edge_docs)) == IDS
    assert secret_scan.scan_secrets(no_docs).count() == 0
    texts = {
        1: "key Zx9Qv7Lm2Kp4Wt8Rb3Nc6Yd1 here",
        2: "sha d41d8cd98f00b204e9800998ecf8427e",  # a digest: base hex, nothing added
        3: "id 123e4567-e89b-12d3-a456-426614174000 v1.22.333-4444.55555",
        4: "internationalization123 and HyperTextMarkupLanguage5",
        5: "Token= 'abcdef' PASSWORD:12345 toKen=abcdefgh passwd==x\"y",
        6: "AKIA" + "A" * 15 + " AKIAAKIA" + "B" * 16,
        7: "𝄞𝄞 secret=" + "q" * 7,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in secret_scan.scan_secrets(docs).collect()}
    assert got[1].spans == "random:4:28" and not got[1].base
    for i in (2, 3, 4, 5, 6, 7):
        assert not got[i].added
        import hashlib

        assert hashlib.sha256(got[i].base_list.encode()).hexdigest() == brute.secret_base(texts[i])[3]
    assert got[2].spans == "hex:4:36" and got[7].spans == "assign:3:17"


def test_random_strings_of_every_kind(spark):
    texts = {
        1: "use qVbZtKxWjRmPhDfNcGsL now",  # letters alone
        2: "cookie x7-Kq_9fZ2-mW_4hJt8_Rb here",  # no piece of 16 without a sign
        3: "serial AB3DE-9KF2M-Q7ZTX-W4H8J ok",
        4: "aead0123456789abcdef0123ZqX7vT9pLm2Kw8RbJ4Nc",  # the rest behind a base span
        5: "some-long-hyphenated-name-of-a-page snake_case_function_name_2",
        6: "id-123e4567-e89b-12d3-a456-426614174000 sha1-0123456789ABCDEF0123456789ABCDEF01234567",
        7: "2024-01-15T10-22-33Z 978-0-306-40615-X +49-30-1234-5678-90",
        8: "Donaudampfschifffahrtsgesellschaft INTERNATIONALIZATION SomeCamelCaseClassName12",
        9: "qVbZtKxWjRmPhDfNcGsL1234",  # random, though a number stands behind letters
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {
        r.doc_id: [texts[r.doc_id][x.start : x.end] for x in r.added]
        for r in secret_scan.scan_secrets(docs).collect()
    }
    assert got == {
        1: ["qVbZtKxWjRmPhDfNcGsL"], 2: ["x7-Kq_9fZ2-mW_4hJt8_Rb"], 3: ["AB3DE-9KF2M-Q7ZTX-W4H8J"],
        4: ["ZqX7vT9pLm2Kw8RbJ4Nc"], 5: [], 6: [], 7: [], 8: [], 9: ["qVbZtKxWjRmPhDfNcGsL1234"],
    }


def pages_of(spark, rows):
    return spark.createDataFrame(
        [(*r, "x") for r in rows], "page_id bigint, url string, html string, payload string"
    )


def test_warc(spark, tmp_path):
    big = "<p>" + "é" * 200
    rows = [(5, "u5", big), (3, "u3", big), (3, "u3b", big), (None, None, big), (7, "a\r\nb", None),
            (8, "", "tiny"), (9, "u9", "tiny"), (2, "u2", LONG)]
    back = warc.round_trip(pages_of(spark, rows), f"file://{tmp_path}/w").collect()
    import hashlib

    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in back)
    want = Counter()
    for i, _, page in rows:
        payload = (page or "").encode()
        revisit = page == big and i != 3
        want[i, "revisit" if revisit else "response", 3 if revisit else None, len(payload),
             hashlib.sha256(payload).hexdigest()] += 1
    assert got == want
    assert {r.payload.decode() for r in back if r.page_id == 2} == {LONG}
    assert warc.round_trip(pages_of(spark, []), f"{tmp_path}/none").count() == 0


def test_warc_pushdown_and_plain_archives(spark, tmp_path):
    import gzip

    page = "<p>" + "x" * 3000
    path = f"{tmp_path}/w"
    warc.write_archives(pages_of(spark, [(i, f"u{i}", page) for i in range(20)]), path)
    found = warc.read_archives(spark, path).where("record_type = 'revisit' and refers_to = 0")
    assert found.where("target_uri = 'u7'").count() == 1 and found.count() == 19
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "record_type#" in plan and "= revisit" not in plan
    # members of other writers do not tell their length
    member = gzip.compress(warc.record("response", 1, "u", None, "ab", b"payload"))
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.warc.gz").write_bytes(member * 3)
    assert warc.read_archives(spark, str(other)).count() == 3
    assert [r.payload for r in warc.read_archives(spark, str(other), payload=False).collect()] == [None] * 3


def test_warc_skips_payloads_unread(tmp_path):
    members = warc.pack(warc.record("response", 1, "u", None, "ab", LONG.encode() * 50))
    file = tmp_path / "a.warc.gz"
    file.write_bytes(members * 2 + warc.pack(warc.record("revisit", 2, "u", 1, "ab", b"")))

    class Counting:
        def __init__(self):
            self.file, self.bytes = open(file, "rb"), 0

        def read(self, n):
            data = self.file.read(min(n, 4096))
            self.bytes += len(data)
            return data

        def seek(self, n, whence):
            self.file.seek(n, whence)

    source = Counting()
    got = list(warc.records(source, {"record_type": "revisit"}, True))
    assert [r["page_id"] for r in got] == [2] and source.bytes < file.stat().st_size / 3


def toy_labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_toxicity_learns_and_ignores_held_out_rows(spark):
    insults = ["blorp", "snarg", "frimp"]
    rows = [
        (i, " ".join(f"w{(i * 7 + j * j) % 300}" for j in range(40)) + (f" {insults[i % 3]} you" if i % 5 == 0 else ""))
        for i in range(400)
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    label = {i: int(i % 5 == 0) for i, _ in rows}
    labels = toy_labels(spark, [(i, 1, y) for i, y in label.items()])
    scored = toxicity.score_texts(docs, toxicity.train(docs, labels))
    held = scored.where(toxicity.held_out(F.col("doc_id"))).collect()
    right = sum((r.score >= 0.3) == bool(label[r.doc_id]) for r in held)
    assert len(held) > 50 and right / len(held) > 0.95
    # other labels of held-out rows change nothing
    other = labels.withColumn(
        "toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    again = toxicity.score_texts(docs, toxicity.train(docs, other))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scored.collect()))


def test_toxicity_edge_cases(spark, edge_docs, no_docs):
    none = toy_labels(spark, [])
    scored = toxicity.score_texts(edge_docs, toxicity.train(edge_docs, none))
    assert ids_of(scored) == IDS
    assert [r.score for r in scored.collect()] == pytest.approx([toxicity.PRIOR] * len(EDGE_ROWS))
    odd = toy_labels(spark, [(4, 1, 1), (4, 1, 0), (5, None, None), (None, 1, 1), (6, 1, 0)])
    scored = toxicity.score_texts(edge_docs, toxicity.train(edge_docs, odd))
    assert len({r.score for r in scored.collect() if r.t == scored.where("doc_id = 4").first().t}) == 1
    assert toxicity.score_texts(no_docs, toxicity.train(no_docs, odd)).count() == 0
    assert toxicity.drop_toxic(edge_docs, odd).columns == edge_docs.columns


def test_sentencepiece(spark, edge_docs, no_docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    want = Counter((i, tuple(model.encode(x or ""))) for i, x in EDGE_ROWS)
    for options in ({}, {"giant": 50, "chunk": 64}):
        rows = sentencepiece_codec.round_trip(edge_docs, **options).collect()
        assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
        assert {r.doc_id for r in rows if not r.same} == {8}  # U+2581 comes back as a space
    assert sentencepiece_codec.round_trip(no_docs).count() == 0


def test_transfer_matrices_are_associative_and_exact():
    codec = sentencepiece_codec.Codec(open(sentencepiece_codec.MODEL, "rb").read())
    for text in ("abcabcdedabcaaaabbbb" * 9, "----=====" * 20, "日本語 mixed\n\ntext 𝄞" * 8, " a  b   " * 20):
        s = sentencepiece_codec.prepared(text)
        spans = [(b, min(b + 23, len(s))) for b in range(0, len(s), 23)]
        ms = [codec.transfer(s, b, e) for b, e in spans]
        c = sentencepiece_codec.compose
        assert c(c(ms[0], ms[1]), ms[2]) == c(ms[0], c(ms[1], ms[2]))
        states = sentencepiece_codec.boundary_states(ms)
        ids = []
        for (b, e), x, y in zip(spans, states, states[1:]):
            path = codec.trace(s, b, e, codec.states(s, b)[x], codec.states(s, e)[y])
            ids += [i for p, q in path for i in codec.piece_ids(s[p:q])]
        assert ids == codec.model.encode(text)


PAGES = {
    1: ("<body><div class='top-menu'><a href=x>Home</a></div><div id=c><p>One &amp; <b>t</b>wo"
        "<p>Three\n four<script>var p='<p>no'</script></div><div class=sidebar>No</div>"
        "<section id=comments><p>Nice!</section></body>", "One & two Three four"),
    2: ("<main><article><h1>T</h1><p>x&nbsp; y</p><div class=ad><p>buy</div><p>z</p></article>"
        "<article class=comment><p>me too</p></article></main>", "T x y z"),
    3: (None, ""),
    4: ("", ""),
    5: ("plain text &lt;b&gt; only", "plain text <b> only"),
    6: ("<article><form>f</form><p>a<br>b<!-- c <p> --></p><noscript>n</noscript></article><footer>f", "a b"),
    7: ("<nav>unclosed <p>text", "unclosed text"),
    9: ("<div class='page has-sidebar'><div class=ad-wrapper><article class=post-header><p>k</article>"
        "</div><div class=sidebar>s</div></div>", "k"),
    8: ("<p title='a > b'>q</p><style>p{}</style>" * 3, "q q q"),
}


def test_html(spark):
    rows = [(i, f"u{i}", page) for i, (page, _) in PAGES.items()] + [(1, "u1", PAGES[1][0]), (None, None, "<p>x")]
    out = html_extraction.extract_text(pages_of(spark, rows)).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and got.pop(None) == "x"
    assert got == {i: text for i, (_, text) in PAGES.items()}
    assert all(r.n_chars == len(r.text) for r in out)
    assert html_extraction.extract_text(pages_of(spark, [])).count() == 0


LONG_PARAGRAPH = "word " * 60
MENU = "".join(f"<li><a href=x>Item {i}</a></li>" for i in range(5))
REGIONS = [
    # a heading and a short paragraph in divs of their own
    (f"<div><h1>Head</h1></div><div><div><p>By me</p></div></div><div><p>{LONG_PARAGRAPH}</p></div>"
     "<div><div><div><p>End.</p></div></div></div>", f"Head By me {LONG_PARAGRAPH}End."),
    # lines of links go without any class, and end what is kept
    (f"<p>slogan</p><ul>{MENU}</ul><div><p>{LONG_PARAGRAPH}</p></div><ul>{MENU}</ul><p>(c) x</p>",
     LONG_PARAGRAPH.strip()),
    # an article in several elements, a teaser beside them, a list of links inside that stays
    (f"<article><p>{LONG_PARAGRAPH}</p><ul>{MENU}</ul><p>one</p></article><article><p>two</p></article>"
     "<article><h3><a href=y>More</a></h3><p>teased text</p></article>", f"{LONG_PARAGRAPH}Item 0 Item 1 Item 2 Item 3 Item 4 one two"),
    # a page wrapped in a form, with and without a marked article
    (f"<form id=aspnet><input name=v><article><p>a b</p></article><p>{LONG_PARAGRAPH}</p></form>", "a b"),
    (f"<form id=aspnet><label>l</label><p>{LONG_PARAGRAPH}</p></form><p>x</p>", f"{LONG_PARAGRAPH}x"),
    (f"<p>{LONG_PARAGRAPH}</p><form><p>your name</p></form>", LONG_PARAGRAPH.strip()),
]


@pytest.mark.parametrize("page, text", REGIONS)
def test_main_text(page, text):
    assert html_extraction.main_text(page) == text


def test_text_blocks():
    assert html_extraction.text_blocks([0, 5, 0, 0, 7, 0, 0, 0, 0, 2, 1]) == [(1, 7), (9, 11)]
    assert html_extraction.text_blocks([]) == [] and html_extraction.text_blocks([0, 0]) == []


def test_pipeline_stages(spark, tmp_path, edge_docs):
    """Each stage on the odd rows, and on none; all but the last keep the columns."""
    given = edge_docs.select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"),
        F.char_length("text").cast("bigint").alias("n_chars"),
    )
    toy_labels(spark, [(4, 1, 0), (6, 1, 1), (100, 0, 1)]).write.parquet(f"{tmp_path}/labels.parquet")
    items(spark, [(1, " ".join(LONG.split()[:13]), "")]).write.parquet(f"{tmp_path}/benchmark.parquet")
    given.write.parquet(f"{tmp_path}/documents.parquet")
    for docs in (given, given.limit(0)):
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, docs, str(tmp_path))
            assert out.columns == given.columns, name
            assert out.count() <= docs.count()
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert last.count() == docs.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_against_the_steps_in_plain_python(spark, sf):
    import duckdb

    docs = dict(
        duckdb.connect().execute(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    )
    tables = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, step in corpus_pipeline.STAGES:
        tables.append(step(spark, tables[-1], sf))
    kept, deduped, single, clean, encoded = (t.collect() for t in tables[1:])
    assert {r.doc_id for r in kept} <= set(docs)
    assert {r.doc_id for r in deduped} == {r.doc_id for r in kept}
    assert all(r.n_chars == len(r.text) for r in deduped)
    roots = {c for _, _, c in brute.simhash_components([(r.doc_id, r.text) for r in deduped])}
    assert {r.doc_id for r in single} == roots
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {w[0] for w in brute.contamination([(r.doc_id, r.text) for r in single], bench) if w[5]}
    assert {r.doc_id for r in clean} == roots - dirty
    assert {r.doc_id for r in encoded} == roots - dirty and all(r.same for r in encoded)
