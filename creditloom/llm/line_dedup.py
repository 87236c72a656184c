"""Line dedup: later documents lose the passages that they share with earlier ones.

Passages stand inside lines as well as in lines of their own, so the lines that are compared are
runs of words, wherever a line ends.  White space alone parts words.

1.  *Rare line hashes.*  Every run of ``RUN`` words is hashed, long enough to be rare.  Of each
    ``min_words - RUN + 1`` neighbouring runs the smallest hash is kept (winnowing), so a shared
    passage of ``min_words`` words shares a kept one, wherever it stands.
2.  *Overlapping documents.*  A hash that stands in several documents links each of them to
    the first, so a passage of thousands of documents gives as many pairs as documents.  The
    first is a minimum, summed up before it is shuffled.
    That document has the run, but need not have the passage around it.  So runs only give
    candidates: each block of ``min_words`` words that shares a run with a first document but is
    not in it is hashed as a whole, and links its documents to the first of them, which has all
    of it.  (The first document of a block is never excused: no earlier one has the block.)
3.  Blocks that stand in the earlier document from end to end, and apart from others, need no
    search.  *Patience diff* aligns what else a pair has in blocks on the windows of ``WINDOW`` words at every place: those
    unique on both sides, in longest increasing order, then the gaps between them in the same
    way; equal windows that touch an alignment join it.  A gap without unique windows takes its
    rarest shared one instead.  What is left of the later document is aligned again while it has
    ``min_words`` words in a row of the earlier one; where only shorter pieces align, those words
    are a block as they stand.
4.  Aligned blocks of ``min_words`` words or more are deleted from the later document.

An earlier document is one of smaller id (of smaller text hash for equal ids; null ids last).
Only documents of a pair are read again, and their texts meet as arrays of hashes, which are taken
from the bytes of many texts at once (``word_hashes``).  The words are cut out by built-in
functions.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import (
    arrow_rows,
    broadcast_up_to,
    column,
    free_name,
    join_rows,
    let,
    stage,
)
from creditloom.llm.word_hashes import hashed_words, murmur3

MIN_WORDS = 50
RUN = 20
WINDOW = 8
#: Documents up to which the ids of those in pairs are broadcast (some 40 bytes each).
BROADCAST_ROWS = 500_000
BLOCKS = "array<struct<start:int,end:int>>"
BASE = 0x9E3779B97F4A7C15


def patience_matches(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal lines in increasing order."""
    return [(i + k, j + k) for i, j, n in _Pair(a, b).matches() for k in range(n)]


class _Pair:
    """Two lists of lines, as they are and as numbers that are equal for equal lines."""

    def __init__(self, a, b):
        self.lines = np.asarray(a).tolist(), np.asarray(b).tolist()
        kinds, numbers = np.unique(np.concatenate([a, b]), return_inverse=True)
        self.a, self.b = np.split(numbers, [len(a)])
        self.kinds = len(kinds)

    def take(self, start: int, end: int) -> None:
        """Lines of ``b`` that are equal to nothing from now on."""
        end = min(end, len(self.b))
        self.lines[1][start:end] = [(i,) for i in range(start, end)]
        self.b[start:end] = self.kinds + np.arange(start, end)

    def matches(self) -> list[tuple[int, int, int]]:
        """Aligned (i, j, n), n lines from i and j on, in increasing order."""
        out: list[tuple[int, int, int]] = []
        todo = [(0, len(self.a), 0, len(self.b))]
        while todo:
            a0, a1, b0, b1 = todo.pop()
            if n := _equal(self.a[a0:a1], self.b[b0:b1]):
                out.append((a0, b0, n))
                a0, b0 = a0 + n, b0 + n
            if n := _equal(self.a[a0:a1][::-1], self.b[b0:b1][::-1]):
                a1, b1 = a1 - n, b1 - n
                out.append((a1, b1, n))
            if a0 == a1 or b0 == b1:
                continue
            anchors = self.unique_in_order(a0, a1, b0, b1)
            left = (a0, b0)
            for i, j in anchors:
                todo.append((left[0], i, left[1], j))
                left = (i, j)
            if anchors:
                todo.append((left[0], a1, left[1], b1))
        return sorted(out)

    def unique_in_order(self, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
        """Longest increasing chain of lines that stand once on both sides; without any, the
        rarest shared line."""
        lines_a, in_a, n_a = np.unique(self.a[a0:a1], return_index=True, return_counts=True)
        lines_b, in_b, n_b = np.unique(self.b[b0:b1], return_index=True, return_counts=True)
        at = np.minimum(np.searchsorted(lines_b, lines_a), len(lines_b) - 1)
        shared = lines_b[at] == lines_a
        if not shared.any():
            return []
        once = shared & (n_a == 1) & (n_b[at] == 1)
        if not once.any():
            return _rarest(*self.lines, a0, a1, b0, b1)
        i, j = in_a[once], in_b[at[once]]
        order = np.argsort(i)
        i, j = i[order] + a0, j[order] + b0
        if (np.diff(j) < 0).any():
            chain = _longest_chain(j.tolist())
            i, j = i[chain], j[chain]
        return list(zip(i.tolist(), j.tolist()))


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many lines are equal from the first on."""
    n, step, at = min(len(a), len(b)), 16, 0
    while at < n:
        other = a[at : min(n, at + step)] != b[at : min(n, at + step)]
        if other.any():
            return at + int(other.argmax())
        at, step = at + step, 4 * step
    return n


def _longest_chain(js: list[int]) -> list[int]:
    """Numbers of a longest increasing chain."""
    ends: list[int] = []  # smallest last j of a chain of each length
    tops: list[int] = []  # and the one it belongs to
    before: list[int] = []
    for k, j in enumerate(js):
        n = bisect_left(ends, j)
        before.append(tops[n - 1] if n else -1)
        ends[n : n + 1], tops[n : n + 1] = [j], [k]
    chain, k = [], tops[-1] if tops else -1
    while k >= 0:
        chain.append(k)
        k = before[k]
    return chain[::-1]


def _rarest(a, b, a0, a1, b0, b1) -> list[tuple[int, int]]:
    """First places of the rarest shared line, where no line is unique on both sides."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    line = min(in_a.keys() & in_b.keys(), key=lambda x: in_a[x] * in_b[x])
    return [(a.index(line, a0, a1), b.index(line, b0, b1))]


def shared_blocks(a: list, b: list, window: int, min_words: int) -> list[tuple[int, int]]:
    """[start, end) in words of the blocks of ``min_words`` words or more of ``b`` that are in ``a``.

    ``a`` and ``b`` are the windows at every place, so n aligned ones are n + window - 1 words.
    A block that stands in ``a`` from end to end and shares no word with another is aligned by
    one of the passes below whatever its order, so it is taken at once, and its words align with
    nothing else.
    An alignment keeps order, so what is left of ``b`` is aligned again while a whole block of it
    is in ``a``: blocks that changed places, or stand in ``b`` twice, are found too.  Where the
    alignment has short pieces alone, those blocks are taken as they stand.
    """
    size = min_words - window + 1
    numbers = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    runs_a, runs_b = (rolling(_spread(x), size) for x in np.split(numbers, [len(a)]))
    return _blocks(a, b, *_first_places(runs_a, runs_b), window, min_words)


def _first_places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes of ``b`` are in ``a``, and the first place of each of these there."""
    if not len(a):
        return np.zeros(len(b), dtype=bool), np.empty(0, dtype=np.int64)
    order = np.argsort(a, kind="stable")
    ordered = a[order]
    at = np.minimum(np.searchsorted(ordered, b), len(a) - 1)
    found = ordered[at] == b
    return found, order[at[found]]


def _among(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Which hashes of ``b`` are in ``a``."""
    if not len(a):
        return np.zeros(len(b), dtype=bool)
    ordered = np.sort(a)
    return ordered[np.minimum(np.searchsorted(ordered, b), len(a) - 1)] == b


def _blocks(
    a: np.ndarray, b: np.ndarray, left: np.ndarray, first_places: np.ndarray, window: int, min_words: int
) -> list[tuple[int, int]]:
    """The same, given which whole blocks of ``b`` are in ``a``, and where there first."""
    left, size = left.copy(), min_words - window + 1
    if not left.any():
        return []
    found, out, rest = _straight_blocks(first_places, left, min_words), [], None
    while True:
        out += found
        for start, end in found:
            first = max(0, start - window + 1)
            if rest is not None:
                rest.take(first, end)
            left[max(0, first - size + 1) : end] = False
        if not left.any():
            return sorted(out)
        if rest is None:
            rest = _Pair(a, b)
            for start, end in out:
                rest.take(max(0, start - window + 1), end)
        found = _aligned_blocks(rest, window, min_words) or _stretches(left, min_words)


def _straight_blocks(i: np.ndarray, left: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Blocks of places ``left`` that stand in ``a`` as they are, from the places ``i`` there on,
    and share no word with another."""
    j = np.flatnonzero(left)
    cut = np.flatnonzero(np.diff(j) != 1) + 1
    starts, stops = np.concatenate([[0], cut]), np.concatenate([cut, [len(j)]])
    bends = np.concatenate([[0], np.cumsum(np.diff(i - j) != 0)])
    first, end = j[starts], j[stops - 1] + min_words
    overlaps = end[:-1] > first[1:]
    alone = ~(np.concatenate([[False], overlaps]) | np.concatenate([overlaps, [False]]))
    kept = alone & (bends[stops - 1] == bends[starts])
    return list(zip(first[kept].tolist(), end[kept].tolist()))


def _stretches(at: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """[start, end) of the words of the blocks that begin at the places of ``at``; overlaps are one."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], at.astype(np.int8), [0]])))
    out: list[tuple[int, int]] = []
    for start, end in edges.reshape(-1, 2).tolist():
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], end - 1 + min_words)
        else:
            out.append((start, end - 1 + min_words))
    return out


def _spread(numbers: np.ndarray) -> np.ndarray:
    h = numbers.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(31))


def _aligned_blocks(pair: _Pair, window: int, min_words: int) -> list[tuple[int, int]]:
    out, last, start = [], None, 0
    for i, j, n in [*pair.matches(), (-2, -2, 0)]:
        if last is None or (i, j) != last:
            if last is not None and last[1] - 1 - start + window >= min_words:
                out.append((start, last[1] - 1 + window))
            start = j
        last = (i + n, j + n)
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE`` and its inverse modulo 2**64 to the powers 0 to n - 1 at least."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 4096)
        for k, x in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            factors = np.full(size, x, dtype=np.uint64)
            factors[0] = 1
            _POWERS[k] = np.cumprod(factors)
    return _POWERS[0], _POWERS[1]


_POWERS = [np.empty(0, dtype=np.uint64)] * 2


def summed(h: np.ndarray) -> np.ndarray:
    """What the numbers before each place add to a polynomial modulo 2**64; ``rolled`` takes it."""
    out = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * _powers(len(h))[1][: len(h)], out=out[1:])
    return out


def rolled(sums: np.ndarray, run: int) -> np.ndarray:
    """Hashes of the runs of ``run`` numbers at every place, from ``summed``."""
    n = len(sums) - run
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    total = (sums[run:] - sums[:-run]) * _powers(len(sums))[0][run - 1 : run - 1 + n]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xD6E8FEB86659FD93)
    return total


def rolling(h: np.ndarray, run: int) -> np.ndarray:
    """Hashes of the runs of ``run`` numbers at every place."""
    return rolled(summed(h), run)


def winnowed(hashes: np.ndarray, run: int, min_words: int) -> np.ndarray:
    """Distinct kept hashes of the runs of ``run`` words; none if there are under ``min_words``."""
    return _kept(hashes, np.array([0, len(hashes)]), run, min_words)[1]


def _kept(
    hashes: np.ndarray, ends: np.ndarray, run: int, min_words: int
) -> tuple[np.ndarray, np.ndarray]:
    """The same for texts in one array: the text and the hash of each.  The words of a text begin
    and end at neighbouring ``ends``."""
    text, at = _places(ends, min_words)
    if not len(at):
        return text, np.empty(0, dtype=np.int64)
    smallest = rolling(np.ascontiguousarray(hashes).view(np.uint64), run)
    span, wanted = 1, min_words - run + 1
    while span < wanted:  # minima of windows of growing length
        step = min(span, wanted - span)
        smallest = np.minimum(smallest[: len(smallest) - step], smallest[step:])
        span += step
    text, found = _changes(text, smallest[at].view(np.int64))
    order = np.lexsort((found, text))
    return _changes(text[order], found[order])


def _changes(text: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without those that are equal to the one before."""
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return text[new], found[new]


def _places(ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and the place of every window of ``size`` words that stands in one text."""
    counts = np.maximum(np.diff(ends) - size + 1, 0)
    before = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)
    return text, np.arange(counts.sum()) + np.repeat(ends[:-1] - before, counts)


def _winnower(run: int, min_words: int):
    def winnow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for hashes, ends in hashed_words(batch.column("text")):
                of, runs = _kept(hashes, ends, run, min_words)
                of += done
                done += len(ends) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(of), batch.column("t").take(of), pa.array(runs)],
                    names=["id", "t", "run"],
                )

    return winnow


def _windower(window: int):
    """Hashes (32 bits) of the windows of ``window`` words at every place."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for hashes, ends in hashed_words(batch.column("text")):
                text, at = _places(ends, window)
                values = pa.array(murmur3(hashes, window)[at])
                n = len(ends) - 1
                edges = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
                ids, ts = (batch.column(x).slice(done, n) for x in ("id", "t"))
                done += n
                yield pa.RecordBatch.from_arrays(
                    [ids, ts, pa.ListArray.from_arrays(edges, values)],
                    names=["id", "t", "windows"],
                )

    return hashed


def _aligner(window: int, run: int, min_words: int, lacking: bool = True):
    """Per pair the blocks of the later document that go, and, if ``lacking``, hashes of the
    blocks that it has around shared runs and the earlier one does not have."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def texts(lists: pa.ListArray) -> list[np.ndarray]:
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        return [values[i:j] for i, j in zip(ends[:-1], ends[1:])]

    def compared(a: np.ndarray, b: np.ndarray) -> tuple[list[dict], np.ndarray]:
        size, short = min_words - window + 1, run - window + 1
        if len(b) >= size and np.array_equal(a, b):  # the later text goes whole
            return [{"start": 0, "end": len(b) + window - 1}], np.empty(0, dtype=np.int64)
        x, y = summed(_spread(a)), summed(_spread(b))
        whole_b = rolled(y, size)
        left, places = _first_places(rolled(x, size), whole_b)
        found = _blocks(a, b, left, places, window, min_words)
        # shared runs before each place; a block has those that begin in its first places
        other = np.flatnonzero(~left)
        if not lacking or not len(other):
            return [{"start": s, "end": e} for s, e in found], np.empty(0, dtype=np.int64)
        before = np.concatenate([[0], np.cumsum(_among(rolled(y, short), rolled(x, short)))])
        some = before[size - short + 1 :][other] > before[other]
        rest = np.unique(whole_b[other[some]]).view(np.int64)
        return [{"start": s, "end": e} for s, e in found], rest

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(texts(batch.column("earlier")), texts(batch.column("later")))
            docs = zip(map(repr, batch.column("id").to_pylist()), batch.column("t").to_pylist())
            rows = [compared(x, y) for x, y in pairs]
            found = pa.array([x for x, _ in rows], kind)
            rest = pa.array(_new_ones(docs, [x for _, x in rows]), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("t"), found, rest],
                names=["id", "t", "blocks", "missed"],
            )

    return align


def _plain(text: Column) -> Column:
    """``text`` as the built-in functions on strings see it; null is empty."""
    return F.make_valid_utf8(F.coalesce(text, F.lit("")))


def _new_ones(docs: Iterable[tuple], hashes: list[np.ndarray]) -> list[np.ndarray]:
    """``hashes`` without those of the same document that an earlier pair of it has."""
    out: list[np.ndarray] = []
    sent: dict[tuple, np.ndarray] = {}
    for doc, mine in zip(docs, hashes):
        if doc in sent and len(mine):
            mine = mine[~_among(mine, sent[doc])]
            sent[doc] = np.concatenate([sent[doc], mine])
        elif len(mine):
            sent[doc] = mine
        out.append(mine)
    return out


def document_pairs(
    rows: DataFrame, run: int = RUN, min_words: int = MIN_WORDS
) -> DataFrame:
    """``doc`` and ``first`` (structs nameless, id, t) of documents that share a kept hash."""
    arrow_rows(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()
    texts = rows.select("id", "t", _plain(F.col("text")).alias("text"))
    kept = texts.mapInArrow(_winnower(run, min_words), f"id {kind}, t bigint, run bigint")
    return _pairs_by_hash(stage(kept, "runs"))


def _pairs_by_hash(runs: DataFrame) -> DataFrame:
    """Pairs of each document with the first that has the same ``run``; runs has id, t, run."""
    doc = F.struct(F.col("id").isNull().alias("nameless"), "id", "t")
    # most runs stand once; only those that repeat go on with their documents
    repeated = stage(
        runs.groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("run"),
        "repeated-runs",
    )
    again = stage(
        # shuffled at every size, so that disk grows as the input does
        runs.join(repeated.hint("shuffle_hash"), "run", "left_semi").select(
            "run", doc.alias("doc")
        ),
        "runs-of-several",
    )
    first = stage(again.groupBy("run").agg(F.min("doc").alias("first")), "first-documents")
    pairs = again.join(first.hint("shuffle_hash"), "run").where(F.col("doc") != F.col("first"))
    return stage(pairs.select("doc", "first").distinct(), "pairs")


def repeated_blocks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """doc_id, ``t`` (hash of the text) and ``blocks`` ([start, end) in words; sorted) that go."""
    rows = docs.select(
        column(id_col).alias("id"),
        F.xxhash64(column(text_col)).alias("t"),
        column(text_col).alias("text"),
    )
    window, run = min(WINDOW, min_words), min(RUN, min_words)
    pairs = document_pairs(rows, run, min_words)
    members = stage(
        pairs.select(F.explode(F.array("doc", "first")).alias("doc"))
        .distinct()
        .select(F.col("doc.id").alias("i"), F.col("doc.t").alias("h")),
        "members",
    )
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("h"))
    texts = rows.join(broadcast_up_to(members, BROADCAST_ROWS), same, "left_semi")
    kind = rows.schema["id"].dataType.simpleString()
    once = (
        texts.groupBy("id", "t")
        .agg(_plain(F.first("text")).alias("text"))
        .mapInArrow(_windower(window), f"id {kind}, t bigint, windows array<int>")
        .select(F.struct(F.col("id").isNull().alias("nameless"), "id", "t").alias("doc"), "windows")
    )
    once = stage(once, "windows-of-pairs")

    def align(pairs: DataFrame, lacking: bool) -> DataFrame:
        earlier = once.select(F.col("doc").alias("first"), F.col("windows").alias("earlier"))
        return (
            pairs.join(earlier, "first")
            .join(once.withColumnRenamed("windows", "later"), "doc")
            .select("doc.id", "doc.t", "earlier", "later")
            .mapInArrow(
                _aligner(window, run, min_words, lacking),
                f"id {kind}, t bigint, blocks {BLOCKS}, missed array<bigint>",
            )
        )

    by_run = stage(align(pairs, lacking=True), "aligned-by-run")
    missed = by_run.select("id", "t", F.explode("missed").alias("run"))
    new = _pairs_by_hash(missed).join(pairs, ["doc", "first"], "left_anti")
    by_block = align(new, lacking=False)
    aligned = by_run.select("id", "t", "blocks").union(by_block.select("id", "t", "blocks"))
    return (
        aligned.where(F.size("blocks") > 0)
        .groupBy(F.col("id").alias("doc_id"), "t")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("blocks")))).alias("blocks"))
    )


def without_words(text: Column, blocks: Column) -> Column:
    """``text`` without the words of ``blocks`` and the white space behind each of them."""
    blank = r"[\x20\x09-\x0D]*"
    # what is left begins at the first word or where a block ends, outside any other block, and
    # ends before the next block
    starts = F.filter(
        F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), blocks["end"]))),
        lambda s: ~F.exists(blocks, lambda b: (b["start"] <= s) & (s < b["end"])),
    )
    left = let(
        F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+" + blank), F.lit(0)),
        lambda w: F.transform(
            starts,
            lambda s: let(
                F.array_min(F.filter(blocks["start"], lambda x: x >= s)),
                lambda end: F.array_join(
                    F.slice(w, s + 1, F.greatest(F.coalesce(end, F.size(w)) - s, F.lit(0))), ""
                ),
            ),
        ),
    )
    return F.concat(F.regexp_extract(text, "^" + blank, 0), F.array_join(left, ""))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """``docs`` without the passages that stand in earlier documents; all rows and columns stay.

    White space behind a deleted word goes with it.  A copy of an earlier document keeps its row
    with what is left, often an empty text.  Rows that repeat id and text are one document, not
    copies of each other.  Null and empty texts, and those of fewer than ``min_words`` words,
    stay as they are.

    Up to ``BROADCAST_ROWS`` changed documents are broadcast (some 60 bytes each) and no text is
    shuffled; beyond, documents are joined with their blocks by a shuffle.
    """
    blocks = free_name(docs.columns, "_blocks")
    changed = stage(
        repeated_blocks(docs, id_col, text_col, min_words).withColumnRenamed("blocks", blocks),
        "blocks",
    )
    joined = join_rows(docs, broadcast_up_to(changed, BROADCAST_ROWS), id_col, text_col, "left")
    rest = without_words(column(text_col), F.col(blocks))
    text = F.when(F.col(blocks).isNull(), column(text_col)).otherwise(rest)
    return joined.withColumn(text_col, text).select(*[column(c) for c in docs.columns])
