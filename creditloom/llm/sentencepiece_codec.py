"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

The model is a byte-pair one.  Its segmentation has no additive score, but it is the one path of
pieces in which each neighbouring pair is what the pair alone encodes to.  So the weight of a
step from piece to piece is 0 for such a pair and minus infinity for any other, and the path of
weight 0 is the encoding.  Scores of a set of states are then bit sets: the maximum is *or*.

* Documents of up to ``GIANT`` characters are cut before white space, which no piece crosses,
  and each word is encoded by the library once per task and kept.
* Longer ones are cut into chunks of ``CHUNK`` characters, wherever that falls.  The state at
  a cut is the piece that begins before it and ends at or after it.  Each chunk makes its
  transfer matrix from the states at its start to those at its end (all paths meet at both ends
  of a word, so words inside a chunk are single steps); matrices of a document are
  combined (an associative product) into the states of the one path, and each chunk is then
  traced back between its two states, on its own.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from creditloom.llm.common import arrow_rows, column, stage
from creditloom.session import shuffle_partitions

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT = 65_536
CHUNK = 16_384
SPACE = "▁"
#: Words, and pairs of pieces, that a task keeps at most; then it starts anew.
KEPT_WORDS = 300_000
KEPT_PAIRS = 1_000_000

State = tuple[int, int]  # a piece's start and end in the document


class Codec:
    """One model; words and pairs that were encoded are kept."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        m = self.model
        plain = [
            i
            for i in range(m.vocab_size())
            if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))
        ]
        self.ids = {m.id_to_piece(i): i for i in plain}
        self.scores = {m.id_to_piece(i): m.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        self.byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, list[str]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    # ------------------------------------------------------------------- short documents

    def encode_words(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of 32-bit integers."""
        cut = [
            re.findall(" +[^ ]*", " " + t.replace(SPACE, " ")) if t else [] for t in texts
        ]
        here = set().union(*cut)
        new = here.difference(self.words)
        if len(self.words) + len(new) > KEPT_WORDS:
            self.words.clear()
            new = here
        rest = [w for w in new if w != " "]
        for w, ids in zip(rest, self.model.encode([w[1:] for w in rest], num_threads=1)):
            self.words[w] = array("i", ids).tobytes()
        self.words[" "] = np.array([self.ids[SPACE]], dtype=np.int32).tobytes()
        return [b"".join(map(self.words.__getitem__, words)) for words in cut]

    # -------------------------------------------------------------------- giant documents

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text: the best-scored neighbours merge first, the left of equals."""
        parts = list(text)
        while len(parts) > 1:
            scored = [
                (-self.scores[x + y], i)
                for i, (x, y) in enumerate(zip(parts, parts[1:]))
                if x + y in self.scores
            ]
            if not scored:
                break
            i = min(scored)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def is_whole(self, piece: str) -> bool:
        """Whether the text of the piece encodes to the piece."""
        if len(piece) == 1:
            return True
        if piece not in self.whole:
            self.whole[piece] = self.merge(piece) == [piece]
        return self.whole[piece]

    def fits(self, left: str, right: str) -> bool:
        """Whether the two pieces stay apart, and whole, side by side."""
        if right[0] == SPACE and left[-1] != SPACE:
            return True
        key = (left, right)
        if key not in self.pairs:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            self.pairs[key] = self.merge(left + right) == [left, right]
        return self.pairs[key]

    def pieces_at(self, text: str, at: int) -> Iterator[str]:
        """Pieces that begin at a place; a character that is no piece stands for itself."""
        yield text[at]
        for n in range(2, min(self.longest, len(text) - at) + 1):
            piece = text[at : at + n]
            if piece in self.ids and self.is_whole(piece):
                yield piece

    def states(self, text: str, cut: int) -> list[State]:
        """Pieces that begin before ``cut`` and end at or after it, in order."""
        if cut == 0:
            return [(0, 0)]
        return sorted(
            (at, at + len(p))
            for at in range(max(0, cut - self.longest), cut)
            for p in self.pieces_at(text, at)
            if at + len(p) >= cut
        )

    @staticmethod
    def next_word(text: str, at: int, end: int) -> int | None:
        """Where the word that begins at ``at`` ends, if one begins there and ends by ``end``."""
        if text[at] != SPACE or (at > 0 and text[at - 1] == SPACE):
            return None
        first = at
        while first < end and text[first] == SPACE:
            first += 1
        nxt = text.find(SPACE, first, end)
        return nxt if nxt > first else None

    def word_pieces(self, word: str) -> list[str]:
        """Pieces of a word by the library; characters of byte pieces stand for themselves."""
        if word not in self.parts:
            if len(self.parts) >= KEPT_WORDS:
                self.parts.clear()
            ids = np.frombuffer(self.encode_words([word[1:].replace(SPACE, " ")])[0], np.int32)
            out, data = [], b""
            for i in ids.tolist():
                if i in self.bytes:
                    data += self.bytes[i]
                else:
                    out += data.decode()
                    out.append(self.model.id_to_piece(i))
                    data = b""
            self.parts[word] = [*out, *data.decode()]
        return self.parts[word]

    def walk(self, text: str, begin: int, end: int, entry: list[State]) -> dict[State, tuple]:
        """Pieces that begin in [begin, end): the entry states that reach each, and from where.

        Entry states themselves are in the result; the bits number them in order.
        """
        self.encode_words([text[begin:end].replace(SPACE, " ")])  # its words at once
        reached: dict[State, tuple[int, list[State]]] = {
            s: (1 << i, []) for i, s in enumerate(entry)
        }
        ends: dict[int, list[State]] = {}
        for s in entry:
            ends.setdefault(s[1], []).append(s)
        skip = 0
        for at in range(begin, end):
            here = ends.get(at)
            if at < skip or not here:
                continue
            if (nxt := self.next_word(text, at, end)) is not None:
                # a whole word: every path goes through both of its ends
                bits, before = 0, here
                for s in here:
                    bits |= reached[s][0]
                for piece in self.word_pieces(text[at:nxt]):
                    state = (at, at + len(piece))
                    reached[state] = (bits, before)
                    at, before = state[1], [state]
                ends[nxt], skip = before, nxt
                continue
            for piece in self.pieces_at(text, at):
                state = (at, at + len(piece))
                bits, before = 0, []
                for s in here:
                    if s[0] == s[1] or self.fits(text[s[0] : s[1]], piece):
                        bits |= reached[s][0]
                        before.append(s)
                if bits:
                    reached[state] = (bits, before)
                    ends.setdefault(state[1], []).append(state)
        return reached

    def transfer(self, text: str, begin: int, end: int) -> list[int]:
        """Matrix of a chunk: for each state at its end, the states at its start that lead there."""
        reached = self.walk(text, begin, end, self.states(text, begin))
        return [reached[s][0] if s in reached else 0 for s in self.states(text, end)]

    def trace(self, text: str, begin: int, end: int, first: State, last: State) -> list[State]:
        """The pieces that begin in [begin, end) on the path between two states."""
        reached = self.walk(text, begin, end, [first])
        path, s = [], last
        while s != first:
            path.append(s)
            s = reached[s][1][0]
        return path[::-1]

    def piece_ids(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.byte_ids[b] for b in piece.encode()]

    # --------------------------------------------------------------------------- decoding

    @cached_property
    def texts(self) -> pa.Array:
        """What each id adds to a text, and behind these, what it adds where the text begins.

        Null for ids that are neither pieces nor bytes, and at last for all unknown numbers."""
        out: list[bytes | None] = [None] * self.model.vocab_size()
        for piece, i in self.ids.items():
            out[i] = piece.replace(SPACE, " ").encode()
        begin = [x[1:] if x and x[:1] == b" " else x for x in out]
        for i, x in self.bytes.items():
            out[i] = begin[i] = x
        return pa.array([*out, *begin, None], pa.large_binary())

    def decode(self, lists: pa.ListArray) -> list[str]:
        """Texts of lists of ids (null: empty), as the library gives them.

        They are what the ids add, side by side; the library itself decodes those that hold
        other ids or bytes that are no UTF-8."""
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
        n, ids = self.model.vocab_size(), lists.flatten().fill_null(-1).to_numpy()
        at = np.where((ids >= 0) & (ids < n), ids, 2 * n).astype(np.int64)
        begin = ends[:-1][ends[:-1] < ends[1:]]
        at[begin] = np.minimum(at[begin] + n, 2 * n)
        parts = self.texts.take(pa.array(at))
        other = np.concatenate([[0], np.cumsum(parts.is_null().to_numpy(zero_copy_only=False))])[ends]
        offsets = np.frombuffer(parts.buffers()[1], np.int64)[ends].tolist()
        data, out = memoryview(parts.buffers()[2] or b""), []
        for i, (first, end) in enumerate(zip(offsets[:-1], offsets[1:])):
            try:
                if other[i] < other[i + 1]:
                    raise ValueError("not made of pieces and bytes alone")
                out.append(str(data[first:end], "utf-8"))
            except ValueError:  # broken UTF-8 too
                out += self.model.decode([lists[i].as_py()])
        return out


def prepared(text: str) -> str:
    """The text as the model sees it: a space in front, spaces visible."""
    return SPACE + text.replace(" ", SPACE)


def compose(first: list[int], second: list[int]) -> list[int]:
    """Matrix of two neighbouring chunks; associative."""
    out = []
    for bits in second:
        total = 0
        for i, row in enumerate(first):
            if bits >> i & 1:
                total |= row
        out.append(total)
    return out


def boundary_states(matrices: list[list[int]]) -> list[int]:
    """Number of the state of the one path at each cut, from the first cut to the end.

    Prefix products say which states a path from the start reaches; from the end back, each
    cut takes the one that leads on.
    """
    prefix = [matrices[0]]
    for m in matrices[1:]:
        prefix.append(compose(prefix[-1], m))
    # at the end of the text the path's last piece ends there
    state = next(i for i, bits in reversed(list(enumerate(prefix[-1]))) if bits)
    chosen = [state]
    for k in range(len(matrices) - 1, 0, -1):
        leads = matrices[k][state]
        state = next(i for i, bits in enumerate(prefix[k - 1]) if bits and leads >> i & 1)
        chosen.append(state)
    return [0, *chosen[::-1]]


def _list_array(rows: list[bytes]) -> pa.ListArray:
    values = np.frombuffer(b"".join(rows), dtype=np.int32)
    ends = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


# -------------------------------------------------------------------------------- in tasks


def _encoder(proto):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(proto.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = _list_array(codec.encode_words(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), ids], names=["doc_id", "t", "ids"]
            )

    return encode


def _cutter(chunk: int, margin: int):
    """Chunks with the characters around them that their states need."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = prepared(row["text"].replace(SPACE, " "))
                n = len(s)
                for k, begin in enumerate(range(0, n, chunk)):
                    end = min(begin + chunk, n)
                    left = max(0, begin - margin)
                    yield pa.RecordBatch.from_pylist(
                        [
                            {
                                "doc_id": row["doc_id"],
                                "t": row["t"],
                                "k": k,
                                "at": left,
                                "size": n,
                                "piece": s[left : end + margin],
                            }
                        ],
                        schema=pa.schema(
                            [
                                ("doc_id", batch.schema.field("doc_id").type),
                                ("t", pa.int64()),
                                ("k", pa.int64()),
                                ("at", pa.int64()),
                                ("size", pa.int64()),
                                ("piece", pa.string()),
                            ]
                        ),
                    )

    return cut


def _span(row: dict, chunk: int) -> tuple[int, int]:
    """Begin and end of the chunk inside its piece of text."""
    begin = row["k"] * chunk
    return begin - row["at"], min(begin + chunk, row["size"]) - row["at"]


def _matrices(proto, chunk: int):
    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(proto.value)
            out = [
                [format(bits, "x") for bits in codec.transfer(row["piece"], *_span(row, chunk))]
                for row in batch.to_pylist()
            ]
            columns = [batch.column(c) for c in ("doc_id", "t", "k")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(out, pa.list_(pa.string()))], names=["doc_id", "t", "k", "m"]
            )

    return matrices


def _chooser():
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column("ms").to_pylist():
                ms = [[int(x, 16) for x in r["m"]] for r in sorted(rows, key=lambda r: r["k"])]
                states = boundary_states(ms)
                out.append(
                    [{"k": k, "a": a, "b": b} for k, (a, b) in enumerate(zip(states, states[1:]))]
                )
            kind = pa.list_(pa.struct([("k", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), pa.array(out, kind)],
                names=["doc_id", "t", "states"],
            )

    return choose


def _tracer(proto, chunk: int):
    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(proto.value)
            out = []
            for row in batch.to_pylist():
                text, (begin, end) = row["piece"], _span(row, chunk)
                first = codec.states(text, begin)[row["a"]]
                last = codec.states(text, end)[row["b"]]
                path = codec.trace(text, begin, end, first, last)
                out.append([i for s, e in path for i in codec.piece_ids(text[s:e])])
            columns = [batch.column(c) for c in ("doc_id", "t", "k")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "t", "k", "ids"]
            )

    return trace


def _decoder(proto):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(proto.value)
        for batch in batches:
            texts = codec.decode(batch.column("ids"))
            kept = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"]
            )

    return decode


# ------------------------------------------------------------------------------ operators


def _broadcast_model(df: DataFrame, model: str):
    """The model file (about 0.5 MB), read where the driver runs."""
    with open(model, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str = MODEL,
    giant: int = GIANT,
    chunk: int = CHUNK,
) -> DataFrame:
    """Per row of ``docs``: doc_id, ``t`` (hash of the text) and ids (array of int).

    The ids are those of the SentencePiece library for the whole text.  Null and empty texts
    have none; the character U+2581 counts as a space, as it does in the library.  Repeated rows
    are encoded alike, null ids are ids like others, further columns are not read.
    """
    proto = _broadcast_model(docs, model)
    arrow_rows(docs.sparkSession)
    rows = docs.select(
        column(id_col).alias("doc_id"),
        F.xxhash64(column(text_col)).alias("t"),
        column(text_col).cast("string").alias("text"),
    )
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, t bigint"
    long = F.coalesce(F.char_length("text"), F.lit(0)) > giant
    short_ids = rows.where(~long).mapInArrow(_encoder(proto), f"{kind}, ids array<int>")

    margin = Codec(proto.value).longest
    if chunk <= margin:
        raise ValueError("a chunk must be longer than the longest piece")
    giants = rows.where(long)
    cut = giants.mapInArrow(
        _cutter(chunk, margin), f"{kind}, k bigint, at bigint, size bigint, piece string"
    )
    # few bytes take long, so adaptive execution must not put them into one task
    keys, tasks = ["doc_id", "t", "k"], shuffle_partitions(docs.sparkSession)
    chunks = stage(cut.repartition(tasks, *keys).dropDuplicates(keys), "chunks")
    matrices = stage(
        chunks.mapInArrow(_matrices(proto, chunk), f"{kind}, k bigint, m array<string>"),
        "matrices",
    )
    states = (
        matrices.groupBy("doc_id", "t")
        .agg(F.collect_list(F.struct("k", "m")).alias("ms"))
        .mapInArrow(_chooser(), f"{kind}, states array<struct<k:bigint,a:bigint,b:bigint>>")
        .select("doc_id", "t", F.explode("states").alias("s"))
        .select("doc_id", "t", "s.k", "s.a", "s.b")
    )
    s, c = stage(states, "states").alias("s"), chunks.alias("c")
    same = (
        F.col("c.doc_id").eqNullSafe(F.col("s.doc_id"))
        & (F.col("c.t") == F.col("s.t"))
        & (F.col("c.k") == F.col("s.k"))
    )
    traced = (
        c.join(s, same)
        .select("c.*", "s.a", "s.b")
        .mapInArrow(_tracer(proto, chunk), f"{kind}, k bigint, ids array<int>")
        .groupBy("doc_id", "t")
        .agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
        .select(
            F.col("doc_id").alias("_d"),
            F.col("t").alias("_t"),
            F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
        )
    )
    again = giants.select("doc_id", "t").join(  # once for each row that repeats
        stage(traced, "giant-ids"),
        F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")),
    )
    return short_ids.unionByName(again.select("doc_id", "t", "ids"))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` with the text of its ``ids`` in ``decoded``; null ids give an empty text.

    Columns beside ``ids`` are kept; a column ``decoded`` would be replaced.
    """
    arrow_rows(encoded.sparkSession)
    rows = encoded.drop("decoded")
    schema = StructType([*rows.schema.fields, StructField("decoded", StringType())])
    return rows.mapInArrow(_decoder(_broadcast_model(rows, model)), schema)


def round_trip(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """Encoded and decoded again: doc_id, n_tokens, ids, same (whether the text came back).

    ``same`` compares hashes of the texts; it is false where the text holds U+2581.
    """
    model = options.get("model", MODEL)
    back = decode(encode(docs, id_col, text_col, **options), model)
    same = (F.xxhash64("decoded") == F.col("t")) | (
        (F.col("t") == F.xxhash64(F.lit(None).cast("string"))) & (F.col("decoded") == "")
    )
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("same")
    )
