"""Main text of web pages by the distribution of text over line blocks.

1.  One pass over the page finds the tags.  A quoted value may hold ``<`` and ``>``; a quote that
    is not closed before a space, ``/`` or ``>`` opens none.  A tag without ``>`` ends before the
    next ``<`` or with the page.  Comments, scripts, styles and the like go.
2.  Elements that hold no article text by their name (menus, headers, footers, sidebars, adverts,
    forms) go with what is in them and leave blank lines, and so do those whose role, class or id
    consists of such words (``sidebar``, ``site-footer``).  Where other words stand beside them
    (``related-work``), or on a section's id (but for ads, teasers and comments), they only weigh: such a line counts as text if it is
    long and less than half of it is links.  Headings and marked articles are never marked so.
    A form that holds the marked article or half of the page's text is no such element.
3.  Block elements end a line, so a page is a sequence of lines of text; tags in a row make no
    blank lines.
4.  Text lengths are summed over windows of ``WINDOW`` lines, where a line that is half links
    counts as none unless it stands in the marked article.  The text surges where the sum rises
    from zero and dives where it falls to zero; between them lies a block of text.  Fewer lines
    that count as none than a window has, before or behind a block, belong to it.
5.  Where the page marks its article (``article``, else ``main``), the blocks inside it are
    kept: in the largest article, and in all others that are neither inside another nor teasers.
    Else those are kept that have a tenth or more of the text of the largest and less than half
    of it in links, and from them on their neighbours up to the next lines of links.

Time and memory grow with the length of the page, whatever is broken in it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import arrow_rows, column

WINDOW = 3
#: Characters from which on a line of weakly marked text counts.
LONG_LINE = 40
#: Elements without article text; ``label`` only in a form.
DROPPED = frozenset(
    {
        "head", "title", "script", "style", "noscript", "template", "svg", "iframe", "object",
        "embed", "canvas", "audio", "video", "nav", "header", "footer", "aside", "form", "button",
        "select", "textarea", "input", "fieldset", "menu", "menuitem",
    }
)
#: Elements whose content is no markup.
RAW = ("script", "style", "iframe", "textarea", "title")
#: Elements that end a line.
BLOCKS = frozenset(
    {
        "p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol",
        "li", "dl", "dt", "dd", "table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption",
        "blockquote", "pre", "figure", "figcaption", "hr", "address", "details", "summary",
        "center", "dialog", "body", "html", "br",
    }
)
VOID = frozenset(
    {
        "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr",
    }
)
#: Words of class, id and role that mark what is not the article.
NOT_ARTICLE = frozenset(
    {
        "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored",
        "promo", "promotion", "banner", "menu", "menubar", "nav", "navbar", "navigation",
        "breadcrumb", "breadcrumbs", "sidebar", "aside", "header", "masthead", "footer",
        "copyright", "cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "overlay",
        "newsletter", "subscribe", "subscription", "share", "sharing", "social", "related",
        "recommended", "comment", "comments", "disqus", "reply", "replies", "form", "search",
        "login", "widget", "toolbar", "pagination", "pager", "contentinfo", "complementary",
    }
)
#: Words that say nothing about the content beside one of those.
NEUTRAL = frozenset(
    {
        "area", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "center",
        "column", "container", "content", "desktop", "dropdown", "fixed", "global", "icons",
        "inline", "inner", "item", "items", "js", "law", "left", "links", "list", "main", "message",
        "mobile", "outer", "overlay", "page", "panel", "policy", "post", "posts", "primary",
        "respond", "right", "row", "secondary", "section", "sidebar", "signup", "site", "slot",
        "sticky", "stories", "thread", "top", "unit", "user", "wrap", "wrapper",
    }
)
#: Of the first, those that tell a reader's comment or a teaser from the article.
NOT_MAIN_ARTICLE = frozenset(
    {
        "ad", "advert", "sponsored", "promo", "related", "recommended", "comment", "comments",
        "reply", "replies",
    }
)
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
#: A start cannot lie inside a name, and no run is given back: both keep long tags linear.
ATTRIBUTE = re.compile(
    r"(?<![^\s\"'/])([^\s=\"'/<>]++)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]*+)"
)
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"'=]*+)")
IN_TAG = re.compile(r"[^<>\"']*+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
LONG_REFERENCE = re.compile(r"&#(?:[xX]0*+([0-9a-fA-F]*+)|0*+(\d*+));?")

Tag = tuple[str, str, str]  # slash of an end tag, name, attributes


def tags_of(page: str) -> tuple[list[Tag], list[str]]:
    """Tags of a page, and the text before each and behind the last."""
    tags, texts, parts = [], [], []
    last = {c: page.rfind(c) for c in ("\"", "'", ">")}
    unclosed: set[str] = set()

    def tag_end(i: int) -> int:
        while True:
            before, i = i, IN_TAG.match(page, i).end()
            if i == len(page) or page[i] == "<":
                return i
            if page[i] == ">":
                return i + 1
            quote = page[i]
            if page[before:i].rstrip().endswith("="):
                close = page.find(quote, i + 1) if i < last[quote] else -1
                if close > 0 and (close + 1 == len(page) or page[close + 1] in " \t\n\r\f/>"):
                    i = close
            i += 1

    at = 0
    while (i := page.find("<", at)) >= 0:
        m = NAME.match(page, i)
        if m is None:
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4)
                end = len(page) if end < 0 else end + 3
            elif page.startswith(("<!", "<?"), i):
                end = page.find(">", i) + 1 if i < last[">"] else len(page)
            else:  # a sign
                parts.append(page[at : i + 1])
                at = i + 1
                continue
            parts.append(page[at:i])
            at = end
            continue
        parts.append(page[at:i])
        slash, name = m[1], m[2].lower()
        at = tag_end(m.end())
        closed = page[at - 1] == ">"
        attributes = page[m.end() : at - closed]
        if name in RAW_END and not slash and closed and name not in unclosed:
            end = RAW_END[name].search(page, at)
            if end is not None:
                parts.append(" ")
                at = tag_end(end.end())
                continue
            unclosed.add(name)
            if name in ("script", "style"):
                at = len(page)
                break
        texts.append("".join(parts))
        tags.append((slash, name, attributes))
        parts = []
    texts.append("".join(parts) + page[at:])
    return tags, texts


def decoded(text: str) -> str:
    """Character references decoded; numbers beyond all characters are the replacement sign."""

    def shorter(m: re.Match) -> str:
        digits = m[1] or m[2] or ""
        if len(digits) > 8:
            return "\ufffd"
        return m[0] if len(m[0]) < 64 else f"&#{'' if m[1] is None else 'x'}{digits or 0};"

    return html.unescape(LONG_REFERENCE.sub(shorter, text) if "&#" in text else text)


class Line:
    """Text of one line, that of its links, the article it stands in, and if an element went here.

    ``article`` is 0 outside, and negative in an article inside another.  ``weak`` lines stand in
    an element that may not belong to the article.
    """

    __slots__ = ("article", "gap", "linked", "parts", "weak")

    def __init__(self, article: int, gap: bool = False, weak: bool = False):
        self.parts, self.linked = [], 0
        self.article, self.gap, self.weak = article, gap, weak

    def text(self) -> str:
        return " ".join(decoded("".join(self.parts)).split())

    def weight(self, length: int, in_article: bool) -> int:
        """Characters that count: none of a line of links, nor of a weak one that is short."""
        if self.weak:
            return length if length >= LONG_LINE and 2 * self.linked < length else 0
        return length if in_article or 2 * self.linked < length else 0


def mark_of(name: str, attributes: str) -> int:
    """2 if an element is not of the article, 1 if it may not be, else 0.

    ``has-sidebar`` and the like tell of a neighbour.
    """
    if name in DROPPED:
        return 2
    if not attributes or name in ("html", "body", "main") or name in HEADINGS:
        return 0
    marks = NOT_MAIN_ARTICLE if name == "article" else NOT_ARTICLE
    found = 0
    for m in ATTRIBUTE.finditer(attributes):
        kind = m[1].lower()
        if kind not in ("class", "id", "role"):
            continue
        for token in m[2].strip("\"'").split():
            parted = re.sub("([a-z])([A-Z])", r"\1-\2", token).lower()
            words = [x for x in re.split("[^a-z]+", parted) if x]
            if not words or words[0] in ("has", "with", "no", "without") or marks.isdisjoint(words):
                continue
            anchor = (kind, name) == ("id", "section") and NOT_MAIN_ARTICLE.isdisjoint(words)
            if not anchor and all(x in marks or x in NEUTRAL for x in words):
                return 2
            found = 1
    return found


def closing_places(tags: list[Tag]) -> dict[int, int]:
    """Number of the end tag of each start tag that has one, by nesting of its own name."""
    opened: dict[str, list[int]] = {}
    out = {}
    for i, (slash, name, attributes) in enumerate(tags):
        if slash:
            if opened.get(name):
                out[opened[name].pop()] = i
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            opened.setdefault(name, []).append(i)
    return out


def lines_of(page: str) -> tuple[list[Line], set[int]]:
    """Lines of a page, and which articles are ``main`` elements; dropped elements leave as many blank lines as a window has.

    An element that is never closed loses nothing but its tag, and one that holds the marked
    article goes by its name alone.
    """
    tags, pieces = tags_of(page)
    ends = closing_places(tags)
    marks = [0 if slash else mark_of(name, attributes) for slash, name, attributes in tags]
    marked = [
        i
        for i, (slash, name, _) in enumerate(tags)
        if name in ("article", "main") and not slash and marks[i] < 2
    ]
    text = list(accumulate((len("".join(x.split())) for x in pieces), initial=0))

    def holds_article(i: int) -> bool:
        k = bisect_right(marked, i)
        return k < len(marked) and marked[k] < ends[i]

    def holds_text(i: int) -> bool:
        return 2 * (text[ends[i] + 1] - text[i + 1]) >= text[-1] > 0

    lines, article, links, number, mains = [Line(0)], [0], [], 0, set()
    skip = weak = form = -1
    for i, (slash, name, _) in enumerate(tags):
        if i <= skip:
            continue
        _add(lines[-1], pieces[i], bool(links))
        gone = i in ends and (marks[i] == 2 or name == "label" and i < form)
        if i in ends and marks[i] == 1 and not holds_article(i):
            weak = max(weak, ends[i])
        if name == "form" and gone and (holds_article(i) or holds_text(i)):
            form = max(form, ends[i])
            lines.append(Line(article[-1], weak=i < weak))
        elif gone and (name in DROPPED or not holds_article(i)):
            skip = ends[i]
            lines += [Line(article[-1], gap=True) for _ in range(WINDOW)]
            lines.append(Line(article[-1], weak=skip < weak))
        elif name in ("article", "main"):
            if not slash and i in ends:
                number += 1
                top = article[-1]
                if name == "main":
                    article.append(top or number)
                    mains |= set() if top else {number}
                else:
                    article.append(number if not top or top in mains else -number)
            elif slash and len(article) > 1:
                article.pop()
            lines.append(Line(article[-1], weak=i < weak))
        elif name == "a":
            if slash and links:
                links.pop()
            elif not slash and i in ends:
                links.append(i)
        elif name in BLOCKS:
            lines.append(Line(article[-1], weak=i < weak))
    _add(lines[-1], pieces[-1], False)
    return lines, mains


def _add(line: Line, text: str, linked: bool) -> None:
    line.parts.append(text)
    if linked:
        line.linked += len(text.strip())


def text_blocks(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """[surge, dive) of each stretch whose windows of lines hold text."""
    n = len(lengths)
    total, sums = 0, []
    for i, x in enumerate(lengths):
        total += x - (lengths[i - window] if i >= window else 0)
        sums.append(total)  # of the window that ends at i
    out, surge = [], None
    for i in range(n):
        if surge is None and lengths[i]:
            surge = i
        elif surge is not None and sums[i] == 0:
            out.append((surge, i))
            surge = None
    if surge is not None:
        out.append((surge, n))
    return out


def regions(lines: list[Line], texts: list[str], mains: set[int]) -> set[int]:
    """The articles that are kept; none if the page marks none that has text."""
    size: dict[int, int] = {}
    linked: dict[int, int] = {}
    headed: dict[int, bool] = {}  # whether the first line is a link, as of teasers
    for line, text in zip(lines, texts):
        if line.article and text:
            k = line.article
            size[k] = size.get(k, 0) + len(text)
            linked[k] = linked.get(k, 0) + line.linked
            headed.setdefault(k, 2 * line.linked >= len(text))
    if not size:
        return set()
    best = max(size, key=lambda k: (size[k], -abs(k)))
    main = best if best in mains else 0
    return {best} | {
        k
        for k in size
        if k > 0 and k not in mains and 2 * linked[k] < size[k] and (headed[best] or main or not headed[k])
    }


def blocks_of(texts: list[str], weights: list[int]) -> list[tuple[int, int, bool]]:
    """(start, end, whether none counts) of the blocks of text and of the lines between them."""
    out, at = [], 0
    for start, end in [*text_blocks(weights), (len(texts), len(texts))]:
        while end < len(texts) and end > start and not weights[end - 1]:
            end -= 1  # lines of links up to the next block are looked at together
        between = [i for i in range(at, start) if texts[i]]
        if len(between) >= WINDOW:
            out.append((between[0], between[-1] + 1, True))
        elif between and (start < len(texts) or out):
            if start < len(texts):
                start = between[0]
            else:
                out[-1] = (out[-1][0], between[-1] + 1, False)
        elif between:
            out.append((between[0], between[-1] + 1, True))
        if end > start:
            out.append((start, end, False))
        at = end
    return out


def main_text(page: str | None) -> str:
    lines, mains = lines_of(page or "")
    kept = [(line, text) for line in lines if (text := line.text()) or line.gap]
    articles = regions(*zip(*kept), mains) if kept else set()
    if articles:
        kept = [(line, text if line.article in articles else "") for line, text in kept]
    texts, linked = [t for _, t in kept], [x.linked if t else 0 for x, t in kept]
    weights = [x.weight(len(t), bool(articles)) for x, t in kept]
    blocks = blocks_of(texts, weights)
    if articles:
        chosen = [k for k, x in enumerate(blocks) if not x[2]] or range(len(blocks))
    else:
        sizes = [sum(map(len, texts[s:e])) for s, e, _ in blocks]
        sparse = [not x and 2 * sum(linked[s:e]) < n for (s, e, x), n in zip(blocks, sizes)]
        most = max((n for n, x in zip(sizes, sparse) if x), default=0)
        grown = {k for k, n in enumerate(sizes) if sparse[k] and 10 * n >= most}
        for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
            last = None
            for k in order:
                if sparse[k] and last in grown:
                    grown.add(k)
                last = k
        chosen = sorted(grown)
    return " ".join(t for k in chosen for t in texts[blocks[k][0] : blocks[k][1]] if t)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
            names=["page_id", "url", "text"],
        )


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points).

    Character references are decoded, white space inside a block becomes one space, blocks are
    joined in page order.  A null or empty page has an empty text.  Repeated rows and null ids
    are rows like others; further columns are not read.
    """
    arrow_rows(pages.sparkSession, 64)
    rows = pages.select(
        column(id_col).alias("page_id"),
        column(url_col).alias("url"),
        column(html_col).cast("string").alias("html"),
    )
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return rows.mapInArrow(_extract, f"{kinds}, text string").withColumn(
        "n_chars", F.char_length("text").cast("long")
    )
