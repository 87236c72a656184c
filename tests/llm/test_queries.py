"""Registered corpus queries against SQL, plain Python versions and the library's encoder."""

import html
import re

import brute
import duckdb
import pytest
import sentencepiece
from compare import connect, difference

from creditloom.llm import license_templates, queries, sentencepiece_codec, twins

QUERIES = queries.queries()


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.connect().execute(
        f"select doc_id, text from '{sf}/documents.parquet' order by 1"
    ).fetchall()


@pytest.mark.parametrize("name", sorted(twins.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), connect(sf), twins.oracle_sql()[name]) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_licenses(spark, sf, docs):
    rows = QUERIES["op1_license_scan"](spark, sf).collect()
    got = {(r.doc_id, r.license): (r.containment, r.word_start, r.word_end) for r in rows}
    assert got == brute.licenses(docs, license_templates.templates())
    assert got


def test_line_dedup(spark, sf, docs):
    got = dict(QUERIES["op3_line_dedup"](spark, sf).collect())
    assert brute.sharing_with_earlier(sorted(got.items()), 50) == set()
    shared = brute.sharing_with_earlier(docs, 50)
    assert shared and {doc for doc, text in docs if got[doc] != text} == shared
    rest = {doc: re.findall(r"[^\x20\x09-\x0D]+", text or "") for doc, text in got.items()}
    assert rest == brute.without_earlier_runs(docs, 50)


def test_simhash(spark, sf, docs):
    got = sorted(tuple(r) for r in QUERIES["op5_simhash"](spark, sf).collect())
    assert got == brute.simhash_components(docs)


def test_secret_base(spark, sf, docs):
    rows = QUERIES["op6_secret_scan"](spark, sf).collect()
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows}
    assert got == {doc: brute.secret_base(text) for doc, text in docs}


def test_toxicity(spark, sf, docs):
    import zlib

    rows = QUERIES["op8_toxicity"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == [doc for doc, _ in docs]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_sentencepiece(spark, sf, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    rows = QUERIES["op9_sentencepiece"](spark, sf).collect()
    assert {r.doc_id: r.ids for r in rows} == {doc: model.encode(text) for doc, text in docs}
    assert all(r.same and r.n_tokens == len(r.ids) for r in rows)


def test_html(spark, sf):
    pages = duckdb.connect().execute(f"select page_id, html from '{sf}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in QUERIES["op10_html_extraction"](spark, sf).collect()}
    assert len(got) == len(pages)
    for page, source in pages:
        article = re.search(r"<article>(.*)</article>", source, re.S)[1]
        parted = re.sub(r"</?(p|br|h\d|li|ul|div|td|tr|table)\b[^>]*>", " ", article)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", parted)).split())
        assert (got[page].text, got[page].n_chars) == (want, len(want))
