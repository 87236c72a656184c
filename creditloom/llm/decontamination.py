"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

An item is cut into windows of ``window`` words (an item of fewer words is one window), and a
window into word shingles.  The method, on built-in functions alone:

1.  *Tokens.*  The shingles of each document are joined with the shingles of the benchmark;
    what is left is where in which document a benchmark shingle stands.
2.  *Order by rarity.*  Occurrences over all documents give each shingle its frequency.
3.  *Prefix.*  A window must be contained whole, so the prefix that it needs is a single
    token, its rarest shingle.  Only occurrences of that token make candidates.
4.  *Bounds.*  The window's place follows from the token's place in it; it must begin and end
    inside the document.
5.  *Verification.*  Every shingle of the window must stand at its place, and then the words
    of the document there must be equal to those of the window.

Shingles are joined by their hashes and the last step compares text, so hashes decide nothing.
Only occurrences of benchmark shingles are shuffled before that step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import (
    NOT_ALNUM_ASCII,
    broadcast_up_to,
    column,
    join_rows,
    let,
    lower_ascii,
    positions,
    stage,
    words,
)

WINDOW = 13
SHINGLE = 3
#: Rows up to which the benchmark's shingles are broadcast (some 60 bytes each).
BROADCAST_ROWS = 500_000


def item_words(text: Column) -> Column:
    return words(lower_ascii(text), NOT_ALNUM_ASCII)


def benchmark_windows(
    items: DataFrame, item_col: str, text_col: str, window: int, shingle: int
) -> DataFrame:
    """Distinct windows: id, words, length, shingle size, hashes of the shingles, sorted items."""
    cut = items.select(
        column(item_col).cast("string").alias("item"), item_words(column(text_col)).alias("w")
    )
    starts = positions(F.greatest(F.size("w") - window, F.lit(0)) + 1)
    each = (
        cut.where(F.size("w") > 0)
        .select(
            "item",
            F.explode(
                let(F.col("w"), lambda w: F.transform(starts, lambda i: F.slice(w, i + 1, window)))
            ).alias("w"),
        )
        .groupBy("w")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    cut = F.lit(None)
    for k in range(shingle, 0, -1):
        cut = F.when(F.least(F.lit(shingle), F.size("w")) == k, _hashes(F.col("w"), k)).otherwise(cut)
    return each.select(
        F.xxhash64("w").alias("wid"),
        "w",
        F.size("w").alias("len"),
        F.least(F.lit(shingle), F.size("w")).alias("k"),
        F.transform(cut, lambda s: s["sid"]).alias("sids"),
        "items",
    )


def _hashes(w: Column, size: int) -> Column:
    """Hash of the ``size`` words at each place; made of the hashes of the words."""
    return let(
        F.transform(w, lambda x: F.xxhash64(x)),
        lambda h: F.transform(
            positions(F.size(h) - size + 1),
            lambda i: F.struct(
                i.alias("pos"), F.xxhash64(*[F.get(h, i + j) for j in range(size)]).alias("sid")
            ),
        ),
    )


def _occurrences(docs: DataFrame, known: DataFrame, sizes: list[int]) -> DataFrame:
    """Where each benchmark shingle stands: d, t, n_words, pos, sid."""
    found = docs.select(
        "d",
        "t",
        F.size("w").alias("n_words"),
        F.explode(F.concat(*[_hashes(F.col("w"), k) for k in sizes])).alias("s"),
    ).select("d", "t", "n_words", "s.pos", "s.sid")
    return found.join(known, "sid").select("d", "t", "n_words", "pos", "sid").distinct()


def contaminated_words(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, item_ids (sorted strings), spans, n_hit, contaminated.

    ``spans`` are the word places [start, end) inside windows, merged.  A document is
    contaminated if at least a twentieth of its words is hit.  Null texts and ids are kept: a
    null text has no words, rows with equal id and text each get the same result, an item
    without words or without an id matches nothing.  Further columns of ``docs`` and ``items``
    are not read.
    """
    src = docs.select(
        column(id_col).alias("d"),
        F.xxhash64(column(text_col)).alias("t"),
        item_words(column(text_col)).alias("w"),
    )
    items = items.where(column(item_col).isNotNull())
    wins = stage(benchmark_windows(items, item_col, item_text_col, window, shingle), "windows")
    sizes = sorted(r.k for r in wins.select("k").distinct().collect())  # at most ``shingle``
    if sizes:
        rows = _verified(src, _candidates(src, wins, sizes))
    else:
        rows = src.withColumn("at", F.array().cast(AT))
    spans = merged_spans(
        F.sort_array(
            F.array_distinct(
                F.transform("at", lambda c: F.struct(c["start"], (c["start"] + c["len"]).alias("end")))
            )
        ),
        window,
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return (
        rows.select(
            F.col("d").alias("doc_id"),
            F.col("t").alias("text_hash"),
            F.size("w").cast("long").alias("n_words"),
            F.array_sort(
                F.array_distinct(F.flatten(F.transform("at", lambda c: c["items"])))
            ).alias("item_ids"),
            F.when(F.size("at") > 0, spans).otherwise(F.array().cast(SPANS)).alias("spans"),
        )
        .withColumn("n_hit", n_hit)
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with their own columns.

    A row goes if a contaminated document has its id and its text.
    """
    found = contaminated_words(docs, items, id_col, text_col, **options)
    bad = found.where("contaminated").select("doc_id", F.col("text_hash").alias("t")).distinct()
    return join_rows(docs, stage(bad, "contaminated"), id_col, text_col, "left_anti")


AT = "array<struct<start:int,len:int,w:array<string>,items:array<string>>>"
SPANS = "array<struct<start:int,end:int>>"


def _verified(src: DataFrame, candidates: DataFrame) -> DataFrame:
    """All documents with ``at``: the candidates whose words are those of the document."""
    s, c = src.alias("s"), candidates.alias("c")
    same = F.col("s.d").eqNullSafe(F.col("c.d")) & (F.col("s.t") == F.col("c.t"))
    equal = F.filter("c.at", lambda x: F.slice(F.col("s.w"), x["start"] + 1, x["len"]) == x["w"])
    return s.join(c, same, "left").select(
        "s.d", "s.t", "s.w", F.coalesce(equal, F.array().cast(AT)).alias("at")
    )


def _candidates(src: DataFrame, wins: DataFrame, sizes: list[int]) -> DataFrame:
    """Documents with all shingles of a window in a row: d, t, at."""
    known = stage(wins.select(F.explode("sids").alias("sid")).distinct(), "shingles")
    found = stage(
        _occurrences(
            src.where(F.size("w") >= min(sizes)), broadcast_up_to(known, BROADCAST_ROWS), sizes
        ),
        "shingle-places",
    )

    seen = found.groupBy("sid").agg(F.count("*").alias("df"))
    tokens = wins.select("wid", F.posexplode("sids").alias("off", "sid"))
    prefix = (
        tokens.join(seen, "sid")
        .groupBy("wid")
        .agg(F.min(F.struct("df", "off", "sid")).alias("p"))
        .join(wins, "wid")
        .select("p.sid", "p.off", "wid", "w", "len", "sids", "items")
    )
    prefix = broadcast_up_to(stage(prefix, "prefix-tokens"), BROADCAST_ROWS // 10)
    placed = (
        found.join(prefix, "sid")
        .withColumn("start", F.col("pos") - F.col("off"))
        .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
    )
    needed = placed.select(
        *("d", "t", "wid", "start"),
        F.size("sids").alias("need"),
        F.posexplode("sids").alias("j", "sid"),
    ).withColumn("pos", F.col("start") + F.col("j"))
    p, f = needed.alias("p"), found.select("d", "t", "pos", "sid").alias("f")
    same = (
        F.col("p.d").eqNullSafe(F.col("f.d"))
        & (F.col("p.t") == F.col("f.t"))
        & (F.col("p.pos") == F.col("f.pos"))
        & (F.col("p.sid") == F.col("f.sid"))
    )
    whole = (
        p.join(f, same, "left_semi")
        .groupBy("d", "t", "wid", "start", "need")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") == F.col("need"))
    )
    text = broadcast_up_to(wins.select("wid", "len", "w", "items"), BROADCAST_ROWS // 10)
    return (
        whole.join(text, "wid")
        .groupBy("d", "t")
        .agg(F.collect_list(F.struct("start", "len", "w", "items")).alias("at"))
    )


def merged_spans(spans: Column, longest: int) -> Column:
    """Maximal disjoint runs covered by the sorted ``spans``.

    Of spans with one start the longest counts.  A span of at most ``longest`` places can only
    reach into spans that begin less than ``longest`` later, so each looks at that many
    neighbours and not at all of them.
    """

    def longest_per_start(at: Column) -> Column:
        return F.filter(
            at, lambda s, i: F.coalesce(F.get(at, i + 1)["start"] != s["start"], F.lit(True))
        )

    def runs(at: Column) -> Column:
        def reach(i: Column) -> Column:
            """The furthest end of span i and those before it."""
            first = F.greatest(i - longest + 1, F.lit(0))
            return F.array_max(F.transform(F.slice(at, first + 1, i - first + 1), lambda s: s["end"]))

        begins = F.filter(at, lambda s, i: (i == 0) | (s["start"] > reach(i - 1)))
        last = F.filter(
            positions(F.size(at)),
            lambda i: (i == F.size(at) - 1) | (F.get(at, i + 1)["start"] > reach(i)),
        )
        return F.zip_with(
            begins, last, lambda b, i: F.struct(b["start"].alias("start"), reach(i).alias("end"))
        )

    return let(let(spans, longest_per_start), runs)
