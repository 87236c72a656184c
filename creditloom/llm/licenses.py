"""License scan: MinHash bands over text windows retrieve templates, containment verifies them.

1.  *Shingles.*  Templates are sets of shingles of ``SHINGLE`` words (a shorter one is a single
    shingle).  Shingles of documents that no template has can match nothing, so the universe
    of all sets below is that of the template shingles; the first join keeps only those.  Before
    it a bitmap of the pairs of words that begin template shingles passes over all other places.
2.  *Windows.*  For each length L that a template has, a document is covered by windows of
    L + S - 1 words, one every S = max(1, L // 8) words, so each run of L words is inside one.
    Windows without a shingle of a template of this length are empty sets and not built.
3.  *Bands.*  A window and a template that passes the verification share at least 0.6 of their
    shingles (0.8 n of at most 1.2 n + n / 8).  With ``BANDS`` = 32 bands of ``ROWS`` = 2 minima a
    pair at 0.6 is missed with probability (1 - 0.36) ** 32 < 1e-6, one at 1.0 never.
4.  *Verification.*  A retrieved template must have ``MIN_CONTAINMENT`` of its shingles, compared
    as text, in the window, and at least half of those that name its version (all of them, where
    it is one).
5.  *Nesting.*  A license is left out where another license of more shared shingles stands around
    it: the text of three BSD clauses is no text of two.

Everything is built-in functions.  Only occurrences of template shingles are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import broadcast_up_to, column, let, positions, stage, words
from creditloom.llm.license_templates import templates as license_templates

SHINGLE = 5
MIN_CONTAINMENT = 0.8
BANDS = 32
ROWS = 2
#: Rows up to which shingles and bands of templates are broadcast (some 100 bytes each).
BROADCAST_ROWS = 200_000

#: Bytes of the bitmap of first words.
BITMAP = 1 << 18
_VERSIONED = "(^| )(version|license|licence|v|by|sa|nc|nd|gpl|lgpl|agpl|mpl|epl) [0-9]+"
#: Shingles that name a version and go on, and those that end with it.
VERSION_INSIDE = f"{_VERSIONED} [^ ]"
VERSION_AT_END = f"{_VERSIONED}$"


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(license_templates(), "license string, text string")


def license_words(text: Column) -> Column:
    return words(F.lower(text), r"[^\p{L}\p{N}]+")


def shingles(w: Column, size: int) -> Column:
    """pos and text of the shingles of ``size`` words."""
    return F.transform(
        positions(F.size(w) - size + 1),
        lambda i: F.struct(
            i.alias("pos"),
            F.concat_ws(" ", *[F.get(w, i + j) for j in range(size)]).alias("shingle"),
        ),
    )


def template_sets(templates: DataFrame, name_col: str, text_col: str, shingle: int) -> DataFrame:
    """tid, license, length in words, k (words of a shingle), shingles (a set), must (of these).

    ``must`` are those that name a version: the ones that go on behind it if there are any.
    """
    cut = (
        templates.select(
            column(name_col).alias("license"), license_words(column(text_col)).alias("w")
        )
        .where(F.size("w") > 0)
        .distinct()
    )
    parts = None
    for k in range(shingle, 0, -1):
        one = shingles(F.col("w"), k)
        whole = F.size("w") >= k if k == shingle else F.size("w") == k
        parts = F.when(whole, one) if parts is None else parts.when(whole, one)
    sets = cut.select(
        F.xxhash64("license", "w").alias("tid"),
        "license",
        F.size("w").alias("length"),
        F.least(F.lit(shingle), F.size("w")).alias("k"),
        F.array_distinct(F.transform(parts, lambda s: s["shingle"])).alias("shingles"),
    )
    inside = F.filter("shingles", lambda x: x.rlike(VERSION_INSIDE))
    at_end = F.filter("shingles", lambda x: x.rlike(VERSION_AT_END))
    return sets.withColumn("must", F.when(F.size(inside) > 0, inside).otherwise(at_end))


def band_keys(members: Column, bands: int, rows: int) -> Column:
    """One key per band: its number and the minima of ``rows`` hash functions."""

    def minimum(seed: Column) -> Column:
        return F.array_min(F.transform(members, lambda x: F.xxhash64(x, seed)))

    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.xxhash64(b, *[minimum(b * rows + r) for r in range(rows)]),
    )


def find_licenses(
    docs: DataFrame,
    templates: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    name_col: str = "license",
    template_col: str = "text",
    shingle: int = SHINGLE,
    min_containment: float = MIN_CONTAINMENT,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Licenses found: doc_id, license, containment, word_start, word_end, n_windows.

    ``templates`` may have several rows of a license; their number and length bound what is
    broadcast.  One row per document (id and text) and license; rows that repeat both give one.
    Containment and place are those of the best template and window (greatest containment, most
    shared shingles, first place), the place that of the template's shingles, as words
    [word_start, word_end); n_windows counts windows with any template of the license.  Null and
    empty texts hold nothing, nor does an empty table; templates without words or name match
    nothing; further columns are not read.
    """
    spark = docs.sparkSession
    templates = default_templates(spark) if templates is None else templates
    named = templates.where(column(name_col).isNotNull())
    sets = stage(template_sets(named, name_col, template_col, shingle), "templates")
    sizes = [r.k for r in sets.select("k").distinct().orderBy("k").collect()]
    if not sizes:
        return _nothing(docs, id_col)
    found = _occurrences(docs, id_col, text_col, sets, sizes)
    windows = stage(_windows(found).withColumn("wid", F.monotonically_increasing_id()), "windows")
    seen = F.transform("members", lambda m: m["shingle"])
    keyed = windows.select("wid", "length", F.explode(band_keys(seen, bands, rows)).alias("key"))
    table = stage(
        sets.select(
            "tid", "length", F.explode(band_keys(F.col("shingles"), bands, rows)).alias("key")
        ),
        "template-bands",
    )
    retrieved = (
        keyed.join(broadcast_up_to(table, BROADCAST_ROWS), ["length", "key"])
        .select("wid", "tid")
        .distinct()
    )
    pairs = windows.drop("length").join(retrieved, "wid").join(
        broadcast_up_to(sets, BROADCAST_ROWS), "tid"
    )
    shared = F.array_intersect(seen, F.col("shingles"))
    verified = (
        pairs.withColumn("shared", shared)
        .where(F.size("shared") >= min_containment * F.size("shingles"))
        .where(2 * F.size(F.array_intersect("shared", "must")) >= F.size("must"))
        .select(
            *("d", "t", "license", "length", "start"),
            F.size("shingles").alias("n"),
            F.size("shared").alias("n_shared"),
            _place(F.array_min, seen, F.col("shared"), F.lit(0)).alias("a"),
            _place(
                F.array_max, seen, F.array_intersect(F.reverse(seen), F.col("shingles")), F.col("k")
            ).alias("b"),
        )
    )
    order = F.struct(
        (-F.col("n_shared") / F.col("n")).alias("less"), (-F.col("n_shared")).alias("fewer"), "a", "b"
    )
    best = verified.groupBy("d", "t", "license").agg(
        F.min(order).alias("best"),
        F.count_distinct(F.struct("length", "start")).alias("n_windows"),
    )
    # at most one row for each license is gathered
    together = best.groupBy("d", "t").agg(
        F.collect_list(F.struct("license", "best", "n_windows")).alias("all")
    )

    def around(x: Column, y: Column) -> Column:
        return (
            (y["license"] != x["license"])
            & (y["best"]["a"] <= x["best"]["a"])
            & (y["best"]["b"] >= x["best"]["b"])
            & (y["best"]["fewer"] < x["best"]["fewer"])
        )

    outer = F.filter("all", lambda x: ~F.exists("all", lambda y: around(x, y)))
    return together.select("d", F.explode(outer).alias("r")).select(
        F.col("d").alias("doc_id"),
        F.col("r.license").alias("license"),
        (-F.col("r.best.less")).alias("containment"),
        F.col("r.best.a").cast("long").alias("word_start"),
        F.col("r.best.b").cast("long").alias("word_end"),
        F.col("r.n_windows").alias("n_windows"),
    )


def _place(outermost, seen: Column, shared: Column, behind: Column) -> Column:
    """Where the first of ``shared`` stands, the lowest or highest place, plus ``behind``."""
    ends = let(
        F.get(shared, F.lit(0)),
        lambda x: F.transform(F.filter("members", lambda m: m["shingle"] == x), lambda m: m["pos"]),
    )
    return outermost(ends) + behind


def _nothing(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.limit(0).select(
        column(id_col).alias("doc_id"),
        F.lit("").alias("license"),
        F.lit(0.0).alias("containment"),
        F.lit(0).cast("long").alias("word_start"),
        F.lit(0).cast("long").alias("word_end"),
        F.lit(0).cast("long").alias("n_windows"),
    )


def _beginning(w: Column, i: Column, size: int) -> Column:
    """Place in the bitmap of the first word, or the first two, of the shingle at ``i``."""
    hashed = F.xxhash64(F.get(w, i)) if size == 1 else F.xxhash64(F.get(w, i), F.get(w, i + 1))
    return F.pmod(hashed, F.lit(BITMAP)).cast("int")


def _occurrences(
    docs: DataFrame, id_col: str, text_col: str, sets: DataFrame, sizes: list[int]
) -> DataFrame:
    """Where template shingles stand: d, t, k, pos, shingle, lengths (of templates that have it)."""
    known = stage(
        sets.select("k", "length", F.explode("shingles").alias("shingle"))
        .groupBy("k", "shingle")
        .agg(F.collect_set("length").alias("lengths")),
        "template-shingles",
    )
    beginnings = known.select(
        F.explode(
            F.array(
                *[
                    F.when(F.col("k") == k, _beginning(F.split("shingle", " "), F.lit(0), k))
                    for k in sizes
                ]
            )
        ).alias("i")
    )
    bitmap = bytearray(BITMAP)
    for r in beginnings.where("i is not null").distinct().collect():  # at most BITMAP numbers
        bitmap[r.i] = 1
    bits = F.lit(bitmap)

    def known_beginnings(w: Column, size: int) -> Column:
        def known_one(i: Column) -> Column:
            return F.substring(bits, _beginning(w, i, size) + 1, F.lit(1)) == F.lit(bytearray(b"\1"))

        return F.filter(positions(F.size(w) - min(size, 2) + 1), known_one)

    def known_shingles(w: Column) -> Column:
        def at(size: int, places: Column) -> Column:
            return F.transform(
                F.filter(places, lambda i: i + size <= F.size(w)),
                lambda i: F.struct(
                    i.alias("pos"),
                    F.concat_ws(" ", *[F.get(w, i + j) for j in range(size)]).alias("shingle"),
                ),
            )

        pairs = let(
            known_beginnings(w, 2),
            lambda places: F.concat(*[at(k, places) for k in sizes if k > 1] or [at(2, places)]),
        )
        return F.concat(at(1, known_beginnings(w, 1)), pairs) if sizes[0] == 1 else pairs

    each = docs.select(
        column(id_col).alias("d"),
        F.xxhash64(column(text_col)).alias("t"),
        F.explode(let(license_words(column(text_col)), known_shingles)).alias("s"),
    ).select("d", "t", "s.pos", "s.shingle")
    hits = each.join(broadcast_up_to(known, BROADCAST_ROWS), "shingle")
    return stage(hits.select("d", "t", "k", "pos", "shingle", "lengths"), "template-places")


def _windows(found: DataFrame) -> DataFrame:
    """Windows with a template shingle: d, t, length, start, members (pos, shingle; sorted).

    A window of L + S - 1 words that begins at word b holds the shingles at b .. b + L + S - 1 - k.
    """

    def starts(length: Column) -> Column:
        step = F.greatest(F.lit(1), F.floor(length / 8))
        last = F.floor(F.col("pos") / step) * step
        first = F.ceil((F.col("pos") - (length + step - 1 - F.col("k"))) / step) * step
        return F.transform(
            F.sequence(F.greatest(first, F.lit(0).cast("long")), last, step),
            lambda b: F.struct(length.alias("length"), b.alias("start")),
        )

    placed = found.select(
        *("d", "t", "pos", "shingle"),
        F.explode(F.flatten(F.transform("lengths", starts))).alias("w"),
    )
    return placed.groupBy("d", "t", "w.length", "w.start").agg(
        F.sort_array(F.collect_set(F.struct("pos", "shingle"))).alias("members")
    )
