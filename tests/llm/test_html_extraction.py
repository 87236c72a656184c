"""Pages that are broken, very long, or marked by words that also stand in articles."""

import html
import re
import time

import duckdb
import pytest

from creditloom.llm import html_extraction
from creditloom.llm.html_extraction import main_text

PROSE = "Some words of an article that are long enough to count as a line of text."
LINKS = "".join(f"<li><a href=x>Item {i}</a></li>" for i in range(5))


def article(inside: str) -> str:
    return f"<nav><a href=y>menu</a></nav><article><p>{PROSE}</p>{inside}<p>End.</p></article>"


@pytest.mark.parametrize(
    "inside, text",
    [
        (f'<section id="related-work"><h2>Related work</h2><p>{PROSE}</p></section>', f"Related work {PROSE}"),
        (f'<section id="search"><h2>Search</h2><p>{PROSE}</p></section>', f"Search {PROSE}"),
        ('<h1 class="article-header">Title</h1>', "Title"),
        (f"<ul>{LINKS}</ul>", " ".join(f"Item {i}" for i in range(5))),
        ("<p>x <math><mi>y</mi></math> z</p>", "x y z"),
        ("<p><label>Name</label></p>", "Name"),
        ("<dialog>Said.</dialog>", "Said."),
        # what is marked through and through goes, as do short weak lines in a row
        (f'<div class="advert"><p>{PROSE}</p></div>', ""),
        (f'<div class="share-buttons sharing">{LINKS}</div>', ""),
        (f'<section id="comments"><p>{PROSE}</p></section>', ""),
        (f'<div class="relatedPosts"><p>{PROSE}</p></div>', ""),
        (f'<div class="related-xyz"><ul>{LINKS}</ul></div>', ""),
        ('<form><label>Your name</label><input name=n></form>', ""),
    ],
)
def test_marks_in_an_article(inside, text):
    assert main_text(article(inside)) == " ".join(x for x in (PROSE, text, "End.") if x)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p title=\"a > b\" id='<i>'>q</p>", "q"),
        ('<p>a<a href="x>b</a> c</p><p class="y">d</p>', "ab c d"),
        ("<p>it's <b>o'clock</b></p>", "it's o'clock"),
        ("<p id=a'b>c</p><p id=d'e>f</p>", "c f"),
        ("a < b <3 &lt; c", "a < b <3 < c"),
        ("<p <b>x</b> y", "x y"),
        ("x <p class", "x"),
        ("x<!-- never closed <p>y", "x"),
        ("<script>if (a<b) '<!--'</script>x", "x"),
        ("<SCRIPT>x</ScRiPt >y<script>z", "y"),
        ("<title>never closed <p>y", "never closed y"),
        ("a<!-- b -->c<!doctype html>d<?php e ?>f", "acdf"),
        ("&#" + "9" * 5000 + "; &#x" + "F" * 5000 + ";", "� �"),
        ("&#" + "0" * 5000 + "65;&#x" + "0" * 5000 + "42;&#67;&#;", "ABC&#;"),
        ("", ""),
    ],
)
def test_broken_markup(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "part",
    ["<script ", '<p class="', "<a ", "<a href='x>", "<!", "<!--", "<title>", "<p>", "<div><p>", "<p a", "a ",
     "<", "</p>", "&#1", "<p class=\"", "<svg>", "<a href=x>y</a><form>", "=\"'", "<p a='"],
)
def test_time_grows_with_the_page(part):
    page = "<p>text</p>" + part * (1_000_000 // len(part))
    start = time.perf_counter()
    main_text(page)
    main_text("<p " + part.strip("<>") * 50_000 + ">")
    assert time.perf_counter() - start < 15  # the square of the length would take hours


def test_one_long_tag():
    page = "<p " + "a" * 500_000 + " " * 500_000 + "b=" * 200_000 + ">text"
    start = time.perf_counter()
    assert main_text(page) == "text"
    assert time.perf_counter() - start < 5


def test_density_decides_where_nothing_is_marked(spark, sf, monkeypatch):
    """Without marks the menu goes and the whole article stays; as one block, the menu stays too."""
    rows = duckdb.connect().execute(f"select html from '{sf}/pages.parquet'").fetchall()
    plain = []
    for (page,) in rows:
        body = re.sub(r"(</?)(nav|article|footer)\b", r"\1div", page).replace(' class="ad"', "")
        inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
        inside = re.sub(r"</?(p|br|h\d)\b[^>]*>", " ", inside)
        plain.append((body, " ".join(html.unescape(re.sub(r"<[^>]*>", "", inside)).split())))
    got = [main_text(body) for body, _ in plain]
    menus = [re.sub(r"<[^>]*>", " ", re.search(r"<nav>(.*?)</nav>", page, re.S)[1]).split() for (page,) in rows]
    assert all(text in x for x, (_, text) in zip(got, plain))
    assert not any(x.startswith(" ".join(map(html.unescape, menu))) for x, menu in zip(got, menus))
    monkeypatch.setattr(html_extraction, "blocks_of", lambda texts, weights: [(0, len(texts), False)])
    assert all(main_text(body) != x for (body, _), x in zip(plain, got))
