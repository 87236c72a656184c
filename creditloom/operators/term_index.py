"""Exact top passages of questions by TF-IDF, through an inverted index with score bounds.

A passage is a sparse vector of unit length: how often each (hashed) term stands in it, times the
term's rarity.  Passages of like length and like frequent terms stand in one block, and neighbouring
blocks in a group, which is one row: for each of its terms the passages that have it, with counts.
Few rows hold many questions each.  A task gets a group and a part of the questions, so neither
passages nor questions are shuffled for a search, and nothing of the size of questions times
passages is written.  Groups are gone through twice:

* The passages with the strongest terms of a question are scored over these terms alone.  The k-th
  best of these sums over all groups is a floor that a hit must reach.
* The greatest weight of each term in a block bounds what its passages can score; blocks that do not
  reach the floor are skipped.  In the others, the weakest terms of a question which together stay
  below the floor bring no passages; they are only added where a passage may still reach it.

What is skipped is proven away, so the hits are those of the full product.

Raw counts are kept apart from rarities (``counted`` and ``frequencies``), so that new passages
change two small tables and no vector: weights are put on when a question is asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from creditloom.operators.ordering import with_position
from creditloom.operators.vector_index import DISTANCE_DIGITS, MARGIN
from creditloom.session import write_stage

#: Passages of a block, and questions that one task multiplies with it at once.
BLOCK = 1024
BLOCK_QUERIES = 2048
#: Groups that there are at least (if there are as many blocks) before a group has two blocks, blocks
#: of a group at most, and questions that one task has for a group.
GROUPS = 48
GROUP_BLOCKS = 64
GROUP_QUERIES = 32_768
#: Of its terms that stand in most passages, so many tell where a passage belongs.
COMMON = 4
#: Terms whose numbers of passages every task has at hand; those of other terms are joined.
FREQUENT = 1 << 22
#: Entries of a group from which a question takes its floor: terms are taken until they have as many.
FLOOR_ENTRIES = 256
#: Products that are held at a time.
_PRODUCTS = 1 << 21
_KEYS = ["size", "sign", "id"]
_NUMBERS = ["lengths", "by_id", "terms", "rarity", "sizes", "at", "tf"]
#: Steps of rarity for which a task knows how much of each passage is made of terms no rarer.
_STEPS = 32


def _term_hashes(text: Column) -> Column:
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of each row and how often each stands there."""
    for batch in batches:
        hashes = batch.column("_hashes")
        offsets = hashes.offsets.to_numpy()
        terms = hashes.values.to_numpy()[offsets[0] : offsets[-1]]
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        order = np.lexsort((terms, row))
        row, terms = row[order], terms[order]
        new = np.ones(len(terms), bool)
        new[1:] = (row[1:] != row[:-1]) | (terms[1:] != terms[:-1])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(terms))).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=batch.num_rows))])
        ends = pa.array(ends, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.ListArray.from_arrays(ends, pa.array(terms[at], pa.int64())),
                pa.ListArray.from_arrays(ends, pa.array(counts)),
            ],
            names=["id", "terms", "counts"],
        )


def counted(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, terms (ascending hashes) and counts of each text; a null text has none."""
    rows = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(_term_hashes(F.col(text_col)), F.array().cast("array<bigint>")).alias("_hashes"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_count, f"id {kind}, terms array<bigint>, counts array<bigint>")


def frequencies(counts: DataFrame) -> DataFrame:
    """Passages that have each term."""
    return counts.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("n")
    )


def merged_frequencies(old: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Frequencies after passages were added and others removed; all three are frequencies."""
    signed = old.unionByName(added).unionByName(removed.withColumn("n", -F.col("n")))
    return signed.groupBy("term").agg(F.sum("n").alias("n")).where("n > 0")


def _weighted(counts: DataFrame, freq: DataFrame, passages: int) -> DataFrame:
    """query_id, terms and weights of unit length, each times the term's rarity; rarity is
    ln((m + 1) / (n + 1))."""
    rows = counts.select("id", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(
        "id", F.col("t.terms").alias("term"), F.col("t.counts").alias("tf")
    )
    rarity = F.log(F.lit(passages + 1.0) / (F.coalesce("n", F.lit(0)) + 1.0))
    weighed = rows.join(freq.select("term", "n"), "term", "left").select(
        "id", "term", rarity.alias("rarity"), (F.col("tf") * rarity).alias("w")
    )
    # a question has a bounded number of terms
    lists = weighed.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("term", (F.col("w") * F.col("rarity")).alias("w")))).alias("t"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"),
    )
    scale = F.when(F.col("length") > 0, F.col("length")).otherwise(1.0)
    return lists.select(
        F.col("id").alias("query_id"),
        F.col("t.term").alias("q_terms"),
        F.transform("t.w", lambda w: w / scale).alias("q_weights"),
    )


@dataclass(frozen=True)
class TermIndex:
    """``packs``: one row per group of blocks (see ``_packed``); ``freq``: passages of each term."""

    ids: DataFrame
    freq: DataFrame
    passages: int
    packs: DataFrame


def _one_row_per_id(counts: DataFrame) -> DataFrame:
    """Rows of one id are put together; only they are shuffled."""
    many = write_stage(counts.groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    if many.isEmpty():
        return counts
    same = counts["id"].eqNullSafe(many["id"])
    together = counts.join(many, same, "left_semi").groupBy("id")
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("terms", "counts")]
    return counts.join(many, same, "left_anti").unionByName(together.agg(*lists))


def _frequent(freq: DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """The terms of most passages (up to ``FREQUENT``) with their number, and whether these are all."""
    sizes = freq.groupBy("n").count().orderBy(F.desc("n")).collect()  # one row per number
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["n"]
    found = freq.where(F.col("n") >= F.lit(least)).select("term", "n").toArrow()
    terms, n = (found.column(c).to_numpy() for c in ("term", "n"))
    order = np.argsort(terms)
    return terms[order], n[order], total <= FREQUENT


def _entries(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every entry."""
    terms, counts = (batch.column(c) for c in ("terms", "counts"))
    if isinstance(batch, pa.Table):
        terms, counts = terms.combine_chunks(), counts.combine_chunks()
    row = np.repeat(np.arange(len(terms)), terms.value_lengths().to_numpy(zero_copy_only=False))
    return row, terms.flatten().to_numpy(), counts.flatten().to_numpy()


def _numbers(terms: np.ndarray, known: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Passages of each term, 0 if it is not known."""
    if not len(known):
        return np.zeros(len(terms), np.int64)
    at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
    return np.where(known[at] == terms, n[at], 0)


def _rarity(n: np.ndarray, passages: int) -> np.ndarray:
    return np.where(n > 0, np.log((passages + 1.0) / (n + 1.0)), 0.0)


def _keyed(shared, passages: int, starts: list[tuple] | None):
    """Squared length (over frequent terms) and sort key of each passage, which is the logarithm of its
    terms and a sign that passages of like frequent terms share; without ``starts`` that is all, with
    them the passage too and its group, ``starts`` being the least keys of the groups after the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            row, terms, tf = _entries(batch)
            n = _numbers(terms, known, numbers)
            square = np.bincount(row, (tf * _rarity(n, passages)) ** 2, batch.num_rows)
            if "rest" in batch.schema.names:
                square += batch.column("rest").fill_null(0.0).to_numpy(zero_copy_only=False)
            size = np.floor(np.log2(np.bincount(row, minlength=batch.num_rows))).astype(np.int32)
            order = np.lexsort((terms, -n, row))
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            common = order[nth < COMMON]
            mixed = terms[common].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))).view(np.int64)
            sign = np.minimum.reduceat(mixed, np.flatnonzero(np.r_[True, np.diff(row[common]) > 0]))
            keys = [pa.array(size), pa.array(sign), batch.column("id")]
            if starts is None:
                yield pa.RecordBatch.from_arrays(keys, names=_KEYS)
                continue
            marks = [pa.array([s[i] for s in starts], k.type) for i, k in enumerate(keys)]
            both = pa.table(
                [pa.concat_arrays([m, k]) for m, k in zip(marks, keys)]
                + [pa.array(np.arange(len(starts) + batch.num_rows) >= len(starts))],
                names=[*_KEYS, "is_row"],
            )
            place = pc.sort_indices(both, sort_keys=[(c, "ascending") for c in both.column_names]).to_numpy()
            group = np.empty(len(place), np.int64)
            group[place] = np.cumsum(place < len(starts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(group[len(starts) :]),
                    *keys,
                    pa.array(np.sqrt(square)),
                    batch.column("terms"),
                    batch.column("counts"),
                ],
                names=["group", *_KEYS, "length", "terms", "counts"],
            )

    return run


def _packed(shared, passages: int, schema: pa.Schema):
    """A group as one row: its passages in order with their lengths and places by id, its terms in
    order with their rarity (0 if not frequent) and the number of their entries, and the entries
    (passage and count) by term and passage."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in _KEYS])
        row, terms, tf = _entries(rows)
        order = np.argsort(terms, kind="stable")
        row, terms, tf = row[order], terms[order], tf[order]
        new = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(terms) != 0)])
        row, terms, tf = row[new], terms[new], np.add.reduceat(tf, new)
        first = np.flatnonzero(np.r_[True, np.diff(terms) != 0])
        ids = rows.column("id").combine_chunks()
        by_id = np.empty(len(ids), np.int32)
        by_id[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        cells = [
            ids,
            rows.column("length").combine_chunks(),
            by_id,
            terms[first],
            _rarity(_numbers(terms[first], *shared.value), passages),
            np.diff(np.append(first, len(terms))),
            row,
            tf,
        ]
        arrays = [pa.array(rows.column("group")[:1].to_pylist(), pa.int64())]
        for cell, field in zip(cells, list(schema)[1:]):
            flat = cell if isinstance(cell, pa.Array) else pa.array(cell)
            flat = flat.cast(field.type.value_type)
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat).cast(field.type))
        return pa.table(arrays, schema=schema)

    return pack


def build_index(counts: DataFrame, freq: DataFrame | None = None) -> TermIndex:
    """Index over ``counted`` passages, which are read several times."""
    passages = counts.count()
    freq = write_stage(frequencies(counts), "frequencies") if freq is None else freq
    known, numbers, all_of_them = _frequent(freq)
    spark = counts.sparkSession
    shared = spark.sparkContext.broadcast((known, numbers))
    each = F.transform("counts", lambda c: c.cast("int")).alias("counts")
    rows = _one_row_per_id(counts.select("id", "terms", "counts")).where(F.size("terms") > 0)
    rows = rows.select("id", "terms", each)
    if not all_of_them:
        rows = rows.join(_rest(rows, freq, numbers, passages), "id", "left")
    id_type = counts.schema["id"].dataType
    kind = id_type.simpleString()
    keys = f"size int, sign bigint, id {kind}"
    span = _span(passages)
    starts = []
    if passages > span * BLOCK:
        light = write_stage(rows.mapInArrow(_keyed(shared, passages, None), keys), "keys")
        placed = with_position(light, [F.col(c) for c in _KEYS], "place")
        first = placed.where((F.col("place") > 1) & ((F.col("place") - 1) % (span * BLOCK) == 0))
        starts = [tuple(r[c] for c in _KEYS) for r in first.orderBy("place").collect()]  # one row per group
    grouped = rows.mapInArrow(
        _keyed(shared, passages, starts),
        f"group bigint, {keys}, length double, terms array<bigint>, counts array<int>",
    ).groupBy("group")
    packs = T.StructType(
        [T.StructField("group", T.LongType())]
        + [
            T.StructField(name, T.ArrayType(of))
            for name, of in (
                ("ids", id_type),
                ("lengths", T.DoubleType()),
                ("by_id", T.IntegerType()),
                ("terms", T.LongType()),
                ("rarity", T.DoubleType()),
                ("sizes", T.IntegerType()),
                ("at", T.IntegerType()),
                ("tf", T.IntegerType()),
            )
        ]
    )
    packed = grouped.applyInArrow(_packed(shared, passages, to_arrow_schema(packs)), packs)
    return TermIndex(counts.select("id"), freq, passages, write_stage(packed, "term-packs"))


def _rest(rows: DataFrame, freq: DataFrame, numbers: np.ndarray, passages: int) -> DataFrame:
    """What the terms that are not frequent add to the squared length of a passage."""
    entries = rows.select("id", F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    rare = freq.where(F.col("n") < F.lit(int(numbers.min()) if len(numbers) else 2**62))
    weight = F.col("t.counts") * F.log(F.lit(passages + 1.0) / (F.col("n") + 1.0))
    found = entries.join(rare, F.col("t.terms") == F.col("term")).select("id", weight.alias("w"))
    return found.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("rest"))


def _span(passages: int) -> int:
    """Blocks of a group."""
    return min(max(-(-passages // BLOCK) // GROUPS, 1), GROUP_BLOCKS)


# --------------------------------------------------------------------------- search


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ``starts[i]`` and on, ``sizes[i]`` of them, for all i; and the i of each."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return starts[of] + nth, of


def _most_so_far(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running maximum inside runs, ``first`` being where the run of each number begins."""
    span = x.max(initial=0.0) - x.min(initial=0.0) + 1.0
    lift = np.cumsum(first == np.arange(len(x))) * span
    return np.maximum.accumulate(x + lift) - lift


def _least_so_far(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    x = np.minimum(x, 1.0)
    return -_most_so_far(-x, first)


class _Pack:
    """A group of blocks with the greatest weight of each term in each block."""

    def __init__(self, row: dict[str, pa.Array]):
        numbers = {c: row[c].to_numpy(zero_copy_only=False) for c in _NUMBERS}
        self.ids, self.by_id, self.terms = row["ids"], numbers["by_id"], numbers["terms"]
        self.at, self.sizes = numbers["at"], numbers["sizes"].astype(np.int64)
        self.passages, self.blocks = len(self.ids), -(-len(self.ids) // BLOCK)
        lengths = numbers["lengths"]
        self.weight = numbers["tf"] / np.where(lengths > 0, lengths, 1.0)[self.at]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.term_of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        block = self.at // BLOCK
        runs = np.flatnonzero(np.r_[True, (np.diff(self.term_of) != 0) | (np.diff(block) != 0)])
        self.run_block, self.run_top = block[runs], np.maximum.reduceat(self.weight, runs)
        self.run_start = np.searchsorted(runs, self.starts)
        self.run_size = np.diff(np.append(self.run_start, len(runs)))
        self.top = np.maximum.reduceat(self.run_top, self.run_start)
        self._cells = None
        # the length that each passage has over the terms up to each step of rarity
        rarity = numbers["rarity"]
        self.rarity, most = rarity, max(float(rarity.max(initial=0.0)), 1e-9)
        self.step = np.where(rarity > 0, np.minimum(rarity / most * _STEPS, _STEPS - 1), _STEPS).astype(np.int64)
        cell = self.step[self.term_of] * self.passages + self.at
        square = np.bincount(cell, (self.weight * rarity[self.term_of]) ** 2, (_STEPS + 1) * self.passages)
        upto = np.cumsum(square.reshape(_STEPS + 1, -1)[:_STEPS], axis=0)
        self.length = np.sqrt(upto) * (1 + 1e-9)
        self.longest = self.length.max(axis=1)

    def limits(self, row: np.ndarray, term: np.ndarray, w: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """For each question and block the most that a passage can score, and whether a term is shared."""
        run, of = _spread(self.run_start[term], self.run_size[term])
        cell = row[of] * self.blocks + self.run_block[run]
        size = rows * self.blocks
        bound = np.bincount(cell, w[of] * self.run_top[run], size)
        return bound.reshape(rows, -1), (np.bincount(cell, minlength=size) > 0).reshape(rows, -1)

    def sums(
        self, row: np.ndarray, term: np.ndarray, w: np.ndarray, visits: np.ndarray | None
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Question, passage and sum of the entries given, for questions in order, part by part."""
        sizes = self.sizes[term]
        upto = np.cumsum(sizes)
        lo = 0
        while lo < len(row):
            hi = max(int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _PRODUCTS)), lo + 1)
            hi = int(np.searchsorted(row, row[hi - 1], side="right"))
            entry, of = _spread(self.starts[term[lo:hi]], sizes[lo:hi])
            question, passage = row[lo:hi][of], self.at[entry].astype(np.int64)
            value = w[lo:hi][of] * self.weight[entry]
            lo = hi
            if visits is not None:
                goes = visits[question, passage // BLOCK]
                question, passage, value = question[goes], passage[goes], value[goes]
            if not len(question):
                continue
            first, rows = question[0], question[-1] - question[0] + 1
            key = (question - first) * self.passages + passage
            if 4 * len(key) > rows * self.passages:
                total = np.bincount(key, value, rows * self.passages)
                key = np.flatnonzero(total)
                total = total[key]
            else:
                order = np.argsort(key)
                key, value = key[order], value[order]
                new = np.flatnonzero(np.r_[True, np.diff(key) != 0])
                key, total = key[new], np.add.reduceat(value, new)
            yield key // self.passages + first, key % self.passages, total

    def unit(self, term: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Weights of a question without the rarity that stands for that of the passage."""
        return np.divide(w, self.rarity[term], out=np.zeros_like(w), where=self.rarity[term] > 0)

    def at_most(self, row: np.ndarray, term: np.ndarray, w: np.ndarray) -> np.ndarray:
        """For entries by question, common terms first: the most that a passage can score over the
        terms of the question up to here.  That is the sum of what each can give, or the product of
        the lengths of question and passage over these terms."""
        if not len(row):
            return np.empty(0)
        first = np.maximum.accumulate(np.where(np.r_[True, row[1:] != row[:-1]], np.arange(len(row)), 0))

        def upto(x: np.ndarray) -> np.ndarray:
            total = np.cumsum(x)
            return total - (total - x)[first]

        step = self.step[term]
        lengths = np.append(self.longest, np.inf)[step]
        product = np.sqrt(np.maximum(upto(self.unit(term, w) ** 2), 0.0)) * lengths
        gain = w * self.top[term]
        sums = upto(gain)
        # the least product so far may stand for the terms before it: sums since then come on top
        gap = np.where(np.isfinite(product), product - sums, np.inf)
        best = np.minimum(_least_so_far(gap, first), 0.0) + sums
        # bounds must not fall from one term to the next, and sums of floats are a little off
        return _most_so_far(best, first) + 1e-9

    def weights(self, term: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """Weight of each term in its passage, 0 if it does not stand there."""
        if self._cells is None:
            self._cells = self.term_of * self.passages + self.at
        cell = term * self.passages + passage
        at = np.minimum(np.searchsorted(self._cells, cell), len(self._cells) - 1)
        return np.where(self._cells[at] == cell, self.weight[at], 0.0)


def _nth(row: np.ndarray) -> np.ndarray:
    """Place from 0 on in each run of equal numbers, which are in order."""
    at = np.arange(len(row))
    return at - np.maximum.accumulate(np.where(np.r_[True, row[1:] != row[:-1]][: len(row)], at, 0))


def _questions(pack: _Pack, row: dict[str, pa.Array]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the questions, with the question (from the first of the part), term and weight of their
    entries that the group has."""
    sizes, terms, weights = (row[c].to_numpy(zero_copy_only=False) for c in ("q_sizes", "q_terms", "q_weights"))
    ends = np.cumsum(sizes, dtype=np.int64)
    for lo in range(0, len(sizes), BLOCK_QUERIES):
        hi = min(lo + BLOCK_QUERIES, len(sizes))
        part = slice(ends[lo] - sizes[lo], ends[hi - 1])
        of = np.repeat(np.arange(hi - lo), sizes[lo:hi])
        term = np.minimum(np.searchsorted(pack.terms, terms[part]), len(pack.terms) - 1)
        has = pack.terms[term] == terms[part]
        yield slice(lo, hi), of[has], term[has], weights[part][has]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Pack, dict[str, pa.Array]]]:
    """Each group of blocks with each part of the questions."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].values for c in batch.schema.names if c != "group"}
            yield _Pack(row), row


def _group_bounds(k: int, schema: pa.Schema):
    """For each question the blocks of a group that share a term with it, and sums over its
    strongest terms alone of the k passages that have the greatest: none scores less."""

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, asked in _pairs(batches):
            for part, of, term, w in _questions(pack, asked):
                count = part.stop - part.start
                blocks = pack.limits(of, term, w, count)[1].sum(axis=1)
                known = np.flatnonzero(w > 0)
                order = known[np.lexsort((-(w * pack.top[term])[known], of[known]))]
                row, sizes = of[order], pack.sizes[term[order]]
                before = np.cumsum(sizes) - sizes
                start = np.searchsorted(row, row)
                few = (before + sizes - before[start] <= FLOOR_ENTRIES) | (before == before[start])
                some = order[few] if len(order) else order
                rows, best = [np.empty(0, np.int64)], [np.empty(0, np.float32)]
                for question, _, total in pack.sums(of[some], term[some], w[some], None):
                    # positive numbers are in the order of their bits: one sort by question and sum
                    bits = total.astype(np.float32).view(np.uint32).astype(np.int64)
                    key = np.sort((question << 32) | (0xFFFFFFFF - bits))
                    key = key[_nth(key >> 32) < k]
                    rows.append(key >> 32)
                    best.append((0xFFFFFFFF - (key & 0xFFFFFFFF)).astype(np.uint32).view(np.float32))
                rows, best = np.concatenate(rows), np.concatenate(best)
                has = np.flatnonzero(blocks)
                ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=count)[has])]
                query = asked["query_ids"].slice(part.start, count)
                yield pa.RecordBatch.from_arrays(
                    [
                        query.take(pa.array(has)),
                        pa.array(blocks[has].astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(best)).cast(
                            schema.field("best").type
                        ),
                    ],
                    schema=schema,
                )

    return bounds


def _group_product(k: int, schema: pa.Schema):
    """The k best passages of a group for each question, of those that reach its floor, and a row that
    only says how many blocks were visited.

    Blocks whose bound does not reach the floor are not visited.  Terms that together cannot reach
    it (the weakest ones of a question) bring no passages, they only add to those which others brought.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, asked in _pairs(batches):
            floors = asked["floors"].fill_null(0.0).to_numpy(zero_copy_only=False)
            for part, of, term, w in _questions(pack, asked):
                count, floor = part.stop - part.start, floors[part]
                bound, _ = pack.limits(of, term, w, count)
                visits = (bound > 0) & (bound >= floor[:, None])
                seen = np.flatnonzero(visits.any(axis=1))
                mine = np.flatnonzero(visits.any(axis=1)[of] & (w > 0))
                order = mine[np.lexsort((pack.step[term[mine]], of[mine]))]  # common terms first
                row, most = of[order], pack.at_most(of[order], term[order], w[order])
                weak = most < floor[row]
                n = np.bincount(row[weak], minlength=count)  # the bounds of a question grow
                rest, step = np.zeros(count), np.full(count, -1)
                last = np.flatnonzero(weak)[np.cumsum(n)[n > 0] - 1]
                rest[n > 0], step[n > 0] = most[last], pack.step[term[order[last]]]
                norm = np.sqrt(np.bincount(row[weak], pack.unit(term[order[weak]], w[order[weak]]) ** 2, count))
                strong, weak = order[~weak], order[weak]
                weak_n, weak_at = n, np.cumsum(n) - n
                found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
                for question, passage, total in pack.sums(of[strong], term[strong], w[strong], visits):
                    may = np.flatnonzero(total + rest[question] >= floor[question])
                    question, passage, total = question[may], passage[may], total[may]
                    at_step = step[question]
                    more = np.where(
                        (at_step >= 0) & (at_step < _STEPS),
                        np.minimum(rest[question], norm[question] * pack.length[np.clip(at_step, 0, _STEPS - 1), passage]),
                        rest[question],
                    )
                    may = np.flatnonzero(total + more >= floor[question])
                    question, passage, total, more = question[may], passage[may], total[may], more[may]
                    by = np.lexsort((-total, question))
                    kth = np.zeros(count)
                    at = by[_nth(question[by]) == k - 1]
                    kth[question[at]] = total[at] - MARGIN
                    may = np.flatnonzero(total + more >= kth[question])
                    question, passage, total = question[may], passage[may], total[may]
                    for lo in range(0, len(question), _PRODUCTS // 64):
                        one = slice(lo, lo + _PRODUCTS // 64)
                        entry, of_pair = _spread(weak_at[question[one]], weak_n[question[one]])
                        entry = weak[entry]
                        more = w[entry] * pack.weights(term[entry], passage[one][of_pair])
                        total[one] += np.bincount(of_pair, more, len(total[one]))
                    key = np.rint((1.0 - total) * 10**DISTANCE_DIGITS)
                    by = np.lexsort((pack.by_id[passage], key, question))
                    by = by[(_nth(question[by]) < k) & (total[by] > 0) & (total[by] >= floor[question[by]])]
                    found.append((question[by], passage[by], total[by]))
                question, passage, total = (np.concatenate(x) for x in zip(*found))
                query = asked["query_ids"].slice(part.start, count)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([query.take(pa.array(question)), query.take(pa.array(seen))]),
                        pa.concat_arrays([pack.ids.take(pa.array(passage)), pa.nulls(len(seen), pack.ids.type)]),
                        pa.concat_arrays([pa.array(total), pa.nulls(len(seen), pa.float64())]),
                        pa.concat_arrays(
                            [pa.nulls(len(question), pa.int64()), pa.array(visits.sum(axis=1)[seen].astype(np.int64))]
                        ),
                    ],
                    schema=schema,
                )

    return best


def _question_packs(asked: DataFrame, name: str) -> DataFrame:
    """Questions (with a floor if they have one) as few rows, one of about ``GROUP_QUERIES`` each."""
    fields = {c: asked.schema[c].dataType for c in asked.columns}
    named = {"query_id": "query_ids", "q_terms": "q_terms", "q_weights": "q_weights", "floor": "floors"}
    kinds = T.StructType(
        [
            T.StructField(named[c], of if isinstance(of, T.ArrayType) else T.ArrayType(of))
            for c, of in fields.items()
        ]
        + [T.StructField("q_sizes", T.ArrayType(T.IntegerType()))]
    )
    schema, columns = to_arrow_schema(kinds), list(fields)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        cells = [table.column(c).combine_chunks() for c in columns]
        cells.append(cells[columns.index("q_terms")].value_lengths())
        arrays = []
        for cell, field in zip(cells, schema):
            flat = cell.flatten() if field.name in ("q_terms", "q_weights") else cell
            flat = flat.cast(field.type.value_type)
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat).cast(field.type))
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    parts = max(1, -(-asked.count() // GROUP_QUERIES))
    return write_stage(asked.repartition(parts).mapInArrow(pack, kinds), name)


def _crossed(index: TermIndex, questions: DataFrame, run, schema: T.StructType, name: str) -> DataFrame:
    """Every group with every part of the questions, neither of them shuffled; a row is megabytes, so
    tasks get them one by one."""
    conf, batch = questions.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = conf.get(batch)
    conf.set(batch, "1")
    try:
        return write_stage(index.packs.crossJoin(questions).mapInArrow(run, schema), name)
    finally:
        conf.set(batch, rows)


def _best(found: DataFrame, k: int) -> DataFrame:
    place = W.partitionBy("query_id").orderBy(F.round(1 - F.col("score"), DISTANCE_DIGITS), "id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def search(index: TermIndex, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, rank, id, distance) of ``counted`` questions, and the work done for them:
    per question the blocks that share a term with it, and those that were visited.

    Equal distances (at six decimals) go by id.  A question that has nothing in common with k
    passages gets the smallest ids at distance 1.
    """
    asked = write_stage(_weighted(queries, index.freq, index.passages), "asked")
    kinds = T.StructType(
        [
            asked.schema["query_id"],
            T.StructField("blocks", T.LongType()),
            T.StructField("best", T.ArrayType(T.FloatType())),
        ]
    )
    least = _group_bounds(k, to_arrow_schema(kinds))
    bounds = _crossed(index, _question_packs(asked, "question-packs"), least, kinds, "bounds")
    sums = bounds.select("query_id", F.explode("best").alias("score"))
    place = W.partitionBy("query_id").orderBy(F.desc("score"))
    floors = sums.withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k)
    floor = (F.col("score").cast("double") - MARGIN).alias("floor")
    visits = write_stage(asked.join(floors.select("query_id", floor), "query_id", "left"), "visits")
    schema = T.StructType(
        [
            asked.schema["query_id"],
            T.StructField("id", index.ids.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("visited", T.LongType()),
        ]
    )
    product = _group_product(k, to_arrow_schema(schema))
    seen = _crossed(index, _question_packs(visits, "floored-packs"), product, schema, "seen")
    hits = write_stage(
        _best(seen.where(F.col("visited").isNull()).drop("visited"), k).drop("rank"), "found"
    )
    short = (
        queries.select(F.col("id").alias("query_id"))
        .join(hits.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
        .where(F.coalesce("n", F.lit(0)) < k)
        .select("query_id")
    )
    smallest = F.broadcast(index.ids.orderBy("id").limit(2 * k))  # fewer than k of them are hits
    filled = (
        short.join(smallest)
        .join(hits, ["query_id", "id"], "left_anti")
        .withColumn("score", F.lit(0.0))
    )
    shared = bounds.groupBy("query_id").agg(F.sum("blocks").alias("blocks"))
    visited = seen.where(F.col("visited").isNotNull()).groupBy("query_id").agg(F.sum("visited").alias("n"))
    work = shared.join(visited, "query_id", "left").select(
        "query_id", "blocks", F.coalesce("n", F.lit(0)).alias("visited")
    )
    ranked = _best(hits.unionByName(filled), k)
    return ranked.select("query_id", "rank", "id", (1 - F.col("score")).alias("distance")), work
