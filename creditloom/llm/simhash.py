"""SimHash near-duplicates with deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most ``MAX_BITS`` = 3 bits are linked.  Cut into
two segments, one of the segments differs in at most one bit, so with that bit deleted the
segments are equal.  Every distinct fingerprint is indexed under the 32 one-wildcard variants
of each of its two segments, equal variants meet in a join, and the whole distance is verified.

Copies are counted as one fingerprint before anything else.  A variant that more than
``GROUP`` distinct fingerprints share is cut again: the other segment into halves and the
remaining half into quarters, each under its one-wildcard variants.  The same argument holds at
each cut, and after the third at most 11 bits are free, so a group has at most 2,048 members
whatever the data are.  A group returns links that span it, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import (
    WHITE_SPACE,
    arrow_rows,
    column,
    join_rows,
    let,
    lower_ascii,
    positions,
    stage,
    words,
)
from creditloom.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 3
GROUP = 2_048
#: Hashes that a fingerprint unpacks at a time, and distances that a group computes at a time.
BLOCK = 1 << 16


def shingle_hashes(text: Column, size: int) -> Column:
    """XXH64 (seed 42) of each shingle; of the whole sequence if it is shorter."""

    def hashes(w: Column) -> Column:
        full = F.transform(
            positions(F.size(w) - size + 1),
            lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + j) for j in range(size)])),
        )
        return F.when(F.size(w) >= size, full).otherwise(
            F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(
                F.array().cast("array<bigint>")
            )
        )

    return let(words(lower_ascii(text), WHITE_SPACE), hashes)


def majority_bits(hashes: np.ndarray) -> int:
    """Signed 64-bit integer whose bits are set in over half of ``hashes``."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[i : i + BLOCK], dtype="<i8").view(np.uint8)
        counts += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("hashes")
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        fps = [majority_bits(values[i:j]) for i, j in zip(ends[:-1], ends[1:])]
        columns = [batch.column("doc_id"), batch.column("t"), pa.array(fps, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "fp"])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """doc_id, ``t`` (hash of the text) and ``fp`` of every row; texts without words get 0."""
    arrow_rows(docs.sparkSession)
    hashed = docs.select(
        column(id_col).alias("doc_id"),
        F.xxhash64(column(text_col)).alias("t"),
        shingle_hashes(column(text_col), shingle).alias("hashes"),
    )
    kind = hashed.schema["doc_id"].dataType.simpleString()
    return hashed.mapInArrow(_majority, f"doc_id {kind}, t bigint, fp bigint")


# ------------------------------------------------------------------------------- variants


def _variants(value: Column, width: int, tag: int) -> Column:
    """The ``width`` one-wildcard variants of the lowest bits of ``value``, told apart by ``tag``.

    A variant is the bits without the deleted one, the number of that one and the tag.
    """
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda j: F.call_function("shiftleft", (j + tag * width).cast("long"), F.lit(width))
        + value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), j))),
    )


def _part(value: Column, at: int, width: int) -> Column:
    mask = F.lit((1 << width) - 1).cast("long")
    return F.shiftrightunsigned(value, at).bitwiseAND(mask)


def _keyed(fps: DataFrame) -> DataFrame:
    """First cut: fp, k1, rest (the other segment)."""
    low, high = _part(F.col("fp"), 0, 32), _part(F.col("fp"), 32, 32)
    both = F.concat(
        F.transform(_variants(low, 32, 0), lambda k: F.struct(k.alias("k1"), high.alias("rest"))),
        F.transform(_variants(high, 32, 1), lambda k: F.struct(k.alias("k1"), low.alias("rest"))),
    )
    return fps.select("fp", F.explode(both).alias("x")).select("fp", "x.k1", "x.rest")


def _cut_again(keyed: DataFrame, level: int) -> DataFrame:
    """Members of hot groups under a further key, made of a half of ``rest``."""
    width = 32 >> (level - 1)  # bits of each half: 16, then 8
    low, high = _part(F.col("rest"), 0, width), _part(F.col("rest"), width, width)
    both = F.concat(
        F.transform(
            _variants(low, width, 0), lambda k: F.struct(k.alias("k"), high.alias("rest"))
        ),
        F.transform(
            _variants(high, width, 1), lambda k: F.struct(k.alias("k"), low.alias("rest"))
        ),
    )
    keys = [f"k{i}" for i in range(1, level)]
    return keyed.select("fp", *keys, F.explode(both).alias("x")).select(
        "fp", *keys, F.col("x.k").alias(f"k{level}"), "x.rest"
    )


def spanning_links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """(member, smallest member of its piece) for members within ``max_bits`` of each other.

    Compares every member of the group with the ones not reached yet, a block at a time.
    """
    left = np.unique(np.asarray(fps, dtype=np.int64))
    out = []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = np.array([root])
        while len(front) and len(left):
            step = max(1, (BLOCK << 4) // len(left))
            block, front = front[:step], front[step:]
            far = np.bitwise_count((left[None, :] ^ block[:, None]).view(np.uint64))
            near = (far <= max_bits).any(0)
            out += [(int(x), int(root)) for x in left[near]]
            front = np.concatenate([front, left[near]])
            left = left[~near]
    return out


def _group_links(max_bits: int):
    def links(groups: pd.Series) -> pd.Series:
        return groups.map(
            lambda fps: [{"a": a, "b": b} for a, b in spanning_links(fps, max_bits)]
        )

    return F.pandas_udf(links, "array<struct<a:bigint,b:bigint>>")


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` within ``max_bits`` (at most 3)."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments hold for at most 3 differing bits")
    linked, keyed = None, _keyed(fps)
    for level in (1, 2, 3):
        keys = [f"k{i}" for i in range(1, level + 1)]
        counts = stage(
            keyed.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1),
            f"variants-{level}",
        )
        most = counts.agg(F.max("n")).first()[0] or 0
        fits = counts if level == 3 else counts.where(F.col("n") <= group)
        found = (
            keyed.join(fits.drop("n"), keys)
            .groupBy(*keys)
            .agg(F.collect_list("fp").alias("fps"))
            .select(_group_links(max_bits)("fps").alias("links"))
            .select(F.explode("links").alias("x"))
            .select("x.a", "x.b")
            .distinct()
        )
        linked = found if linked is None else linked.union(found)
        if level == 3 or most <= group:
            return linked
        hot = counts.where(F.col("n") > group).drop("n")
        keyed = _cut_again(stage(keyed.join(hot, keys), f"hot-variants-{level}"), level + 1)


# ------------------------------------------------------------------------------ operators


def _by_component(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, group: int
) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows; and per distinct fingerprint the first row of its component."""
    known = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t")
    classes = stage(known.groupBy("fp").agg(F.min(row).alias("first")), "classes")
    arrow_rows(docs.sparkSession, 512)
    links = near_links(classes.select("fp"), max_bits, group)
    roots = connected_components(links, "a", "b")
    named = (
        classes.join(roots, F.col("fp") == F.col("node"), "left")
        .withColumn("root", F.coalesce("root", "fp"))
        .select("fp", "root", "first")
    )
    smallest = named.groupBy("root").agg(F.min("first").alias("first"))
    return known, stage(named.drop("first").join(smallest, "root"), "components")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    group: int = GROUP,
) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    The component is named by the smallest id reachable over links.  Null texts count as
    texts without words and share the fingerprint zero.  A null id is a document like any
    other but names a component only if no other id is in it (null then).  Repeated rows give
    repeated results; further columns are not read; an empty table gives no rows.
    """
    known, components = _by_component(docs, id_col, text_col, shingle, max_bits, group)
    return known.join(components, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
    )


def keep_first(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    group: int = GROUP,
) -> DataFrame:
    """One row of each component, with its own columns: that of the smallest id.

    Null ids come after all others.  Of rows that repeat an id the one with the smallest text
    hash stays, and one of rows that repeat both.
    """
    known, components = _by_component(docs, id_col, text_col, shingle, max_bits, group)
    first = components.select("first.*").distinct()
    rows = known.groupBy("doc_id", "t").agg(F.count("*").alias("n"))
    kept = stage(
        first.alias("f")
        .join(
            rows.alias("r"),
            F.col("f.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("f.t") == F.col("r.t")),
        )
        .select("f.doc_id", "f.t", "n"),
        "kept",
    )
    once, again = kept.where(F.col("n") == 1).drop("n"), kept.where(F.col("n") > 1).drop("n")
    rest = join_rows(docs, once, id_col, text_col, "left_semi")
    if again.isEmpty():
        return rest
    repeated = join_rows(docs, again, id_col, text_col, "left_semi")
    return rest.unionByName(repeated.dropDuplicates([id_col, text_col]))
