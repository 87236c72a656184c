"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its hashed features: words, neighbouring pairs, pairs with one or two words
between, and the first letters of words (inflected forms share them).  FTRL-proximal keeps for each feature a learning rate of its own and a weight of
exactly zero until the evidence passes the L1 bound, so the model is a short list of weights.
It is learned in one task, on at most ``TRAIN_ROWS`` labelled rows (whole texts; those of the
smallest id hash), and the list is sent to the tasks that score all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import arrow_rows, column, join_rows, let, stage, words

#: Bounded, documented sample of labelled rows for the classifier.
TRAIN_ROWS = 16_384
THRESHOLD = 0.3
#: Share of toxic documents that is assumed where no row is labelled.
PRIOR = 0.05
#: Of the documents, those whose crc32 remainder by 4 is this are never learned from.
HELD_OUT_REMAINDER = 2
BITS = 20
#: Letters of the beginning of a word.
STEM = 4
#: Odd multipliers of the feature hashes: words, pairs, pairs over one and over two words, stems.
MULTIPLIERS = (
    0x9E3779B97F4A7C15,
    0xC2B2AE3D27D4EB4F,
    0x165667B19E3779F9,
    0xD6E8FEB86659FD93,
    0xA0761D6478BD642F,
    0xE7037ED1A0B428DB,
    0x8EBC6AF09C88C6E3,
    0x589965CC75374CC3,
)


@dataclass(frozen=True)
class Settings:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 4
    bits: int = BITS


def hashed_words(text: Column) -> Column:
    """``words`` and ``stems``: hashes of the words of a text and of their beginnings."""
    return let(
        words(F.lower(text), r"[^\p{L}\p{N}]+"),
        lambda w: F.struct(
            F.transform(w, lambda x: F.xxhash64(x)).alias("words"),
            F.transform(w, lambda x: F.xxhash64(F.left(x, F.lit(STEM)))).alias("stems"),
        ),
    )


def held_out(doc_id: Column) -> Column:
    """False for a null id."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER
    return F.coalesce(rest, F.lit(False))


def features(
    word_hashes: np.ndarray, stem_hashes: np.ndarray, ends: np.ndarray, bits: int
) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the number of the text that each is of; repeats included.

    The arrays hold the hashes of all texts, those of text i between ends[i] and ends[i + 1].
    """
    h = np.ascontiguousarray(word_hashes).view(np.uint64)
    of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    shift = np.uint64(64 - bits)
    m = [np.uint64(x) for x in MULTIPLIERS]
    found = [(h * m[0]) >> shift, (np.ascontiguousarray(stem_hashes).view(np.uint64) * m[7]) >> shift]
    texts = [of, of]
    for gap, left, right in ((1, m[1], m[2]), (2, m[3], m[4]), (3, m[5], m[6])):
        if len(h) > gap:
            same = of[:-gap] == of[gap:]
            second = h[gap:][same]
            pair = h[:-gap][same] * left + (second ^ (second >> np.uint64(29))) * right
            found.append(pair >> shift)
            texts.append(of[gap:][same])
    return np.concatenate(found).astype(np.int64), np.concatenate(texts)


class Ftrl:
    """McMahan's FTRL-proximal with per-coordinate rates; features are 0 or 1."""

    def __init__(self, s: Settings, base: float):
        self.s, self.base = s, base  # log-odds before any feature
        self.z = np.zeros((1 << s.bits) + 1)  # the last one is the intercept
        self.n = np.zeros((1 << s.bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n, s = self.z[at], self.n[at], self.s
        rate = (s.beta + np.sqrt(n)) / s.alpha + s.l2
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / rate)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = _sigmoid(self.base + w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def fit(
    sets: list[np.ndarray], labels: list[int], s: Settings
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights of the features whose weight is not zero; the intercept comes last.

    It starts from the share of label 1, counted as if 2 rows more had ``PRIOR`` of it.
    """
    toxic = sum(labels)
    base = np.log((toxic + 2 * PRIOR) / (len(labels) - toxic + 2 * (1 - PRIOR)))
    model, one = Ftrl(s, base), np.array([1 << s.bits])
    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for i in order.permutation(len(sets)):
            model.learn(np.concatenate([sets[i], one]), labels[i])
    everything = np.arange(len(model.z))
    w = model.weights(everything)
    w[-1] += base
    kept = (w != 0) | (everything == len(w) - 1)
    return everything[kept], w[kept]


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashed = batch.column("hashed")
    w, stems = hashed.field("words"), hashed.field("stems")
    ends = w.offsets.to_numpy()
    first = slice(ends[0], ends[-1])
    return w.values.to_numpy()[first], stems.values.to_numpy()[first], ends - ends[0]


def _learner(s: Settings):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            found, of = features(*_arrays(batch), s.bits)
            pairs = np.unique((of << (s.bits + 1)) | found)  # by text, then feature
            ends = np.searchsorted(pairs >> (s.bits + 1), np.arange(batch.num_rows + 1))
            # one array per batch, half as wide; what is kept of a text is a view of it
            pairs = (pairs & ((2 << s.bits) - 1)).astype(np.int32)
            ids, toxic = batch.column("key").to_pylist(), batch.column("toxic").to_pylist()
            rows += [(ids[i], pairs[ends[i] : ends[i + 1]], toxic[i]) for i in range(len(ids))]
        rows.sort(key=lambda r: r[0])
        at, w = fit([r[1] for r in rows], [r[2] for r in rows], s)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], names=["feature", "weight"])

    return learn


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows: int = TRAIN_ROWS,
    settings: Settings = Settings(),
) -> DataFrame:
    """``feature`` and ``weight`` of the model; the largest feature number is the intercept.

    Rows without an id, without a label or of the held-out remainder are not learned from.  A
    document of several labels has the largest, one of several texts the largest.  Without
    any row every score is ``PRIOR``.
    """
    sample = stage(
        labels.where(
            column(id_col).isNotNull() & column(label_col).isNotNull() & ~held_out(column(id_col))
        )
        .groupBy(column(id_col).alias("_d"))
        .agg(F.max(label_col).cast("int").alias("toxic"))
        # only labels of documents that are there count towards the bound
        .join(docs.select(column(id_col).alias("_d")), "_d", "left_semi")
        .withColumn("key", F.xxhash64("_d"))
        .orderBy("key", "_d")
        .limit(rows),
        "labelled-sample",
    )
    texts = (
        docs.select(column(id_col).alias("_d"), column(text_col).alias("_x"))
        .join(F.broadcast(sample), "_d")  # at most ``rows`` rows
        .groupBy("key", "toxic")
        .agg(F.max("_x").alias("_x"))
        .select("key", "toxic", hashed_words(F.col("_x")).alias("hashed"))
    )
    arrow_rows(docs.sparkSession)
    learned = texts.repartition(1).mapInArrow(_learner(settings), "feature bigint, weight double")
    return stage(learned, "weights")


def _scorer(weights: tuple[np.ndarray, np.ndarray], bits: int):
    at, w = weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << bits) + 1)
        dense[at] = w
        for batch in batches:
            found, of = features(*_arrays(batch), bits)
            known = dense[found] != 0
            pairs = np.unique((of[known] << (bits + 1)) | found[known])
            n = batch.num_rows
            total = np.bincount(
                pairs >> (bits + 1), weights=dense[pairs & ((2 << bits) - 1)], minlength=n
            )
            scores = _sigmoid(total + dense[-1])
            names = [x for x in batch.schema.names if x != "hashed"]
            columns = [batch.column(x) for x in names] + [pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "score"])

    return score


def score_texts(
    docs: DataFrame,
    weights: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """Per row of ``docs``: doc_id, ``t`` (hash of the text) and score.

    Null and empty texts have the score of the intercept alone.  Ids take no part; rows that
    repeat a text repeat its score; further columns are not read.  The weights are at most
    2**bits numbers by construction.
    """
    arrow_rows(docs.sparkSession)
    model = weights.orderBy("feature").toPandas()
    if model.empty:  # no task learned anything
        pair = np.array([1 << settings.bits]), np.array([np.log(PRIOR / (1 - PRIOR))])
    else:
        pair = model["feature"].to_numpy(), model["weight"].to_numpy()
    hashed = docs.select(
        column(id_col).alias("doc_id"),
        F.xxhash64(column(text_col)).alias("t"),
        hashed_words(column(text_col)).alias("hashed"),
    )
    kind = hashed.schema["doc_id"].dataType.simpleString()
    return hashed.mapInArrow(
        _scorer(pair, settings.bits), f"doc_id {kind}, t bigint, score double"
    )


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Rows of ``docs`` that score under ``threshold``, with their own columns."""
    scored = score_texts(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    bad = scored.where(F.col("score") >= threshold).select("doc_id", "t").distinct()
    return join_rows(docs, stage(bad, "toxic"), id_col, text_col, "left_anti")
