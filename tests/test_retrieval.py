import hashlib
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from creditloom.operators import retrieval


def _plain_chunks(text, limit=800):
    """The chunk rule restated: paragraphs, long ones filled line by line."""
    found = []
    for para in (p.strip() for p in text.split("\n\n")):
        if 0 < len(para) <= limit:
            found.append(para)
        elif para:
            box = []
            for line in filter(None, (x.strip() for x in para.split("\n"))):
                if box and len("\n".join([*box, line])) > limit:
                    found.append("\n".join(box))
                    box = []
                box.append(line)
            found.append("\n".join(box))
    return [c for c in found if len(c) > 30]


TEXT = (
    "SECTION 1: Scope of the policy\nThis policy holds for all retail loans of the bank.\n\n"
    "   \n\nshort\n\n" + "\n".join(f"line {i} " + "x" * (i * 37 % 300) for i in range(40))
    + "\n\n" + "y" * 2000 + "\n" + "z" * 40 + "\n\nSECTION 22  Limits AND Caps\n" + "w" * 50
)


def test_chunks_of_a_policy_text(spark):
    df = spark.createDataFrame([("policy", TEXT)], "source string, text string")
    rows = sorted(
        retrieval.chunk_documents(df).select("id", "text", "metadata.*").collect(),
        key=lambda r: r.chunk_index,
    )
    want = _plain_chunks(TEXT)
    assert [r.text for r in rows] == want
    assert rows[0].section == "scope of the policy" and rows[-1].section == "limits and caps"
    assert {r.total_chunks for r in rows} == {len(want)}
    for i, r in enumerate(rows):
        key = f"policy::{i}::{r.text[:50]}".encode()
        assert r.id == hashlib.sha256(key).hexdigest()[:16]
        assert r.char_count == len(r.text) and r.filename == "policy.txt"


@settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.lists(st.text("ab \n", min_size=0, max_size=500), max_size=6).map("\n".join),
        min_size=1,
        max_size=15,
    )
)
def test_chunks_of_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "source int, text string")
    rows = retrieval.chunk_documents(df).select("text", "metadata.*").collect()
    for i, t in enumerate(texts):
        mine = sorted((r for r in rows if r.source == str(i)), key=lambda r: r.chunk_index)
        assert [r.text for r in mine] == _plain_chunks(t)
        assert all(len(r.text) <= 800 or "\n" not in r.text for r in mine)


@pytest.mark.parametrize("query_block", [4096, 4])
def test_nearest_vectors_are_exact(spark, query_block):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 16)).astype(np.float32)
    vectors[::3] = vectors[0]  # a third of the rows are copies of one vector
    queries = np.vstack([vectors[0], rng.normal(size=(10, 16))])
    v = spark.createDataFrame(
        [(i, [float(x) for x in r]) for i, r in enumerate(vectors)],
        "vec_id bigint, embedding array<float>",
    ).repartition(5)
    q = spark.createDataFrame(
        [(f"q{i}", [float(x) for x in r]) for i, r in enumerate(queries)],
        "query_id string, embedding array<float>",
    )
    got = {}
    for r in retrieval.vector_topk(q, v, k=7, query_block=query_block).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, round(r.distance, 6))
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for i, row in enumerate(queries.astype(np.float32).astype(np.float64)):
        d = 1 - unit @ (row / np.linalg.norm(row))
        order = sorted(range(300), key=lambda j: (round(d[j], 6), j))[:7]
        assert [got[f"q{i}"][n + 1][0] for n in range(7)] == order


def test_embedding(spark):
    rows = [(i, t) for i, t in enumerate(["loan default risk", "Loan DEFAULT risk!", "soup", ""])]
    df = spark.createDataFrame(rows, "id int, text string")
    model = retrieval.fit_embedding(df)
    out = {r.id: np.array(r.embedding) for r in retrieval.embed(df, model).collect()}
    assert np.allclose(out[0], out[1])
    assert np.linalg.norm(out[0]) == pytest.approx(1.0, abs=1e-6)
    assert len(out[2]) == retrieval.EMBEDDING_SIZE and not out[3].any()


def test_chunk_upsert(spark):
    a = spark.createDataFrame([("1", "old"), ("2", "keep")], "id string, text string")
    b = spark.createDataFrame([("1", "new"), ("3", "add"), ("3", "add")], "id string, text string")
    assert sorted(tuple(r) for r in retrieval.upsert_chunks(a, b).collect()) == [
        ("1", "new"), ("2", "keep"), ("3", "add"),
    ]


def test_prompt_leaves_out_what_is_missing(spark):
    questions = spark.createDataFrame(
        [("q1", "Why?", 1, "a1"), ("q2", "How?", 1, None)],
        "question_id string, question string, query_id int, application_id string",
    )
    contexts = spark.createDataFrame([(1, "[Source 1: s — general]\nT")], "query_id int, policy_context string")
    latest = spark.createDataFrame(
        [("A1", "C1", 0.12345, "B", "v1")],
        "application_id string, customer_id string, pd_probability_ens double, "
        "risk_grade string, model_version string",
    )
    texts = spark.createDataFrame([("A1", "1. x")], "application_id string, driver_text string")
    out = {
        r.question_id: r.prompt
        for r in retrieval.prompt_rows(
            questions, contexts, retrieval.application_context(latest, texts)
        ).collect()
    }
    assert "PD Probability : 12.35%" in out["q1"] or "PD Probability : 12.34%" in out["q1"]
    assert "SHAP RISK DRIVERS:\n1. x" in out["q1"]
    assert "CUSTOMER" not in out["q2"] and "DRIVERS" not in out["q2"]
    assert re.search(r"QUESTION:\nHow\?\n\nProvide", out["q2"])


def test_documents_folder(spark, tmp_path):
    from creditloom.sources.landing import read_documents

    (tmp_path / "rules.txt").write_text("first line\nsecond line")
    (tmp_path / "other.md").write_text("ignored")
    rows = read_documents(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("rules", "rules.txt", "first line\nsecond line")]


def test_centroids(spark):
    df = spark.createDataFrame(
        [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 2.0])], "label int, embedding array<float>"
    )
    got = {r.label: r.embedding for r in retrieval.centroids(df, "label").collect()}
    assert got == {0: [0.5, 0.5], 1: [2.0, 2.0]}


def test_policy_index(spark, tmp_path):
    from creditloom.plans.policy_index import build_index, retrieve

    docs, index = tmp_path / "docs", str(tmp_path / "index")
    docs.mkdir()
    (docs / "limits.txt").write_text(
        "SECTION 1: Debt limits\nThe ratio of debt to income must stay below one half.\n\n"
        "SECTION 2: Scores\nApplicants need a bureau score of at least 550 points."
    )
    assert build_index(spark, str(docs), index) == 2
    assert build_index(spark, str(docs), index) == 2
    (docs / "fraud.txt").write_text("Report suspicious transfers to the compliance desk at once.")
    assert build_index(spark, str(docs), index) == 3
    questions = spark.createDataFrame(
        [("q1", "Which bureau score do applicants need?"), ("q2", "suspicious transfers?")],
        "query_id string, question string",
    )
    hits = retrieve(spark, index, questions, k=2)
    best = {r.query_id: r for r in hits.where("rank = 1").collect()}
    assert (best["q1"].source, best["q1"].section) == ("limits", "scores")
    assert best["q2"].filename == "fraud.txt" and best["q2"].excerpt.startswith("Report")
    context = {r.query_id: r.policy_context for r in retrieval.context_blocks(hits).collect()}
    assert context["q1"].startswith("[Source 1: limits — scores]\nSECTION 2")
    assert "\n\n---\n\n[Source 2: " in context["q1"]
    (docs / "limits.txt").unlink()
    assert build_index(spark, str(docs), index, reset=True) == 1
