"""Best-fit packing of documents into sequences: hierarchical, residual bins go up a tree.

A document is its token ids and one end id.  Documents longer than a sequence are cut into
pieces as long as a sequence; what is left over is the first piece.  Whole sequences need no
packing.  The other pieces are dealt by a hash into groups of about ``GROUP`` pieces, so that
each group sees the mixture of lengths of the whole table, and packed there:

* each group packs its pieces best fit, the longest first;
* bins that are nearly full are sequences; the underfull ones become items of the next round,
  where ``FAN`` groups meet in one and are packed best fit again, bins as items.  This is repeated
  until one group is left.

What goes up is bounded.  By best fit, two bins of a group that are at most half full cannot
both be there, so of those at most one goes up.  An emptier bin than nearly full that is more
than half full can only take in such a small one; a round above brings at most ``FAN`` of them to
a place, so the ``FAN`` x (rounds above) emptiest ones go up and the rest are sequences as they
are.  The last group therefore has at most FAN x (FAN x rounds + 1) items, however many documents
there are.

Only lengths are shuffled, never ids or texts.  Each round is a written table of (bin, bin it
went into, place there); at the end these tables are joined from the top down.

Rows repeat: each row of a table is a document of its own.  A null text is empty, and an empty
text is one piece of one id (the end).  Ids may be null; other columns are not read.  An empty
table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import arrow_rows, column, stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 0
#: Pieces that one task packs in the first round (24 bytes each).
GROUP = 65_536
#: Groups that meet in one in each later round.
FAN = 8
#: A bin with at most this many free places is nearly full.
SLACK = 16
#: Characters that are tokenized at once; longer texts are cut behind a word, before a space.
CHUNK = 1 << 20

#: Fixed value: where byte-level pair encodings cut texts before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of the vocabulary in a ``tokenizers`` file, merged by ``tiktoken`` (about four times
    faster; the ids are the same, tests compare them).  Special tokens in texts are plain text."""

    def __init__(self, vocabulary: str):
        import tiktoken

        told = json.loads(vocabulary)
        special = {x["content"] for x in told["added_tokens"]}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {
            bytes(byte_of[c] for c in token): i
            for token, i in told["model"]["vocab"].items()
            if token not in special
        }
        self.coding = tiktoken.Encoding(
            "vocabulary", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}
        )

    def encode(self, text: str) -> np.ndarray:
        parts = [
            np.array(self.coding.encode_ordinary(part), dtype="<u4") for part in chunks(text)
        ]
        return np.concatenate(parts) if parts else np.empty(0, "<u4")


#: No word reaches over such a place: behind a word character, before a space.
_CUT = re.compile(r"(?<=\w)(?=[ \n])")


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in parts of about ``size`` characters whose ids, put together, are those of the
    text.  A text without spaces stays whole."""
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    if at < len(text):
        yield text[at:] if at else text


def _piece_writer(vocabulary: str, capacity: int, end_id: int, keep_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(vocabulary), np.array([end_id], "<u4")
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            of, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column("_text").to_pylist()):
                tokens = np.concatenate([encoder.encode(text or ""), end])
                first = len(tokens) % capacity or capacity
                for n, hi in enumerate(range(first, len(tokens) + 1, capacity)):
                    lo = max(0, hi - capacity)
                    of.append(row)
                    piece.append(n)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(tokens[lo:hi].tobytes()))
                    if keep_ids:
                        ids.append(tokens[lo:hi].astype(np.int32))
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(of, pa.int64())),
                "piece_uid": pa.array(np.arange(len(of)) + uid, pa.int64()),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
            if keep_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            uid += len(of)
            yield pa.RecordBatch.from_pydict(columns)

    return cut


def tokenized_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    vocabulary: str = VOCABULARY,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece of at most ``capacity`` ids: doc_id, piece_uid (a number of its own),
    piece (from 0), start, length, ids_crc32 and, if asked for, ids.  Written to a stage."""
    arrow_rows(docs.sparkSession)
    named = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("_text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    with open(vocabulary, encoding="utf-8") as f:  # a parameter of the driver, sent to the tasks
        cut = _piece_writer(f.read(), capacity, end_id, keep_ids)
    schema = (
        f"doc_id {kind}, piece_uid bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
        + ", ids array<int>" * keep_ids
    )
    return stage(named.mapInArrow(cut, schema), "pieces")


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and place of each item, in the order given, and how full each bin becomes.

    An item goes into the fullest bin that has room for it.  Bins are kept by their room, and
    the set of rooms that occur is one number, a bit for each.
    """
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fills, bins, places = 0, [], [], []
    for size in sizes:
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            here = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            here, room = len(fills), capacity
            fills.append(0)
        bins.append(here)
        places.append(capacity - room)
        fills[here] = capacity - room + size
        if room > size:
            with_room[room - size].append(here)
            rooms |= 1 << (room - size)
    return bins, places, fills


def going_up(fills: list[int], capacity: int, slack: int, hosts: int) -> set[int]:
    """Bins that the next round can still make use of; ``hosts`` is 0 in the last round."""
    if not hosts:
        return set()
    open_bins = [b for b, full in enumerate(fills) if full < capacity - slack]
    return {b for b in open_bins if 2 * fills[b] <= capacity} | set(
        sorted(open_bins, key=fills.__getitem__)[:hosts]
    )


def _packer(capacity: int, slack: int, hosts: int, round_no: int):
    """Best fit of the items of one group: item, size, group -> bin, place, full, up, group."""

    def pack(group: pa.Table) -> pa.Table:
        item, size = group.column("item").to_numpy(), group.column("size").to_numpy()
        order = np.lexsort((item, -size))  # the longest first; ties by number
        bins, places, fills = best_fit(size[order].tolist(), capacity)
        up = np.zeros(len(fills), bool)
        up[list(going_up(fills, capacity, slack, hosts))] = True
        bins = np.array(bins, np.int64)
        number = group.column("group")[0].as_py()
        return pa.table(
            {
                "item": item[order],
                "bin": bins | (number << 24) | (round_no << 56),
                "place": np.array(places, np.int64),
                "full": np.array(fills, np.int64)[bins],
                "up": up[bins],
                "group": np.full(len(bins), number, np.int64),
            }
        )

    return pack


_PACKED = "item bigint, bin bigint, place bigint, full bigint, up boolean, group bigint"


def pack_items(
    items: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, group: int = GROUP, fan: int = FAN
) -> DataFrame:
    """``items`` (item: a number of its own, size: 1 to ``capacity``) with sequence_id and offset.

    Numbers of sequences have the round in their highest bits, then the group and the bin.
    """
    n = max(1, -(-items.count() // group))
    rounds, left = 0, n
    while left > 1:
        rounds, left = rounds + 1, -(-left // fan)

    dealt = items.select(
        "item",
        F.col("size").cast("bigint").alias("size"),
        F.pmod(F.xxhash64("item"), F.lit(n)).alias("group"),
    )
    done: list[DataFrame] = []
    for k in range(rounds + 1):
        packer = _packer(capacity, slack, fan * (rounds - k), k + 1)
        packed = stage(dealt.groupBy("group").applyInArrow(packer, _PACKED), f"packed-{k}")
        done.append(packed)
        dealt = packed.where(F.col("up") & (F.col("place") == 0)).select(
            F.col("bin").alias("item"),
            F.col("full").alias("size"),
            F.floor(F.col("group") / fan).alias("group"),
        )
    # from the top down: where the bins of a round ended up
    ends = None
    for packed in reversed(done):
        here = packed.select("item", "bin", "place", "up")
        if ends is None:
            ends = here.select("item", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
            continue
        above = ends.select(F.col("item").alias("bin"), "sequence_id", "offset")
        moved = here.where("up").join(above, "bin").select(
            "item", "sequence_id", (F.col("offset") + F.col("place")).alias("offset")
        )
        stays = here.where(~F.col("up")).select("item", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
        ends = stays.unionByName(moved)
    return ends


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    vocabulary: str = VOCABULARY,
    keep_ids: bool = False,
    slack: int = SLACK,
    group: int = GROUP,
    fan: int = FAN,
) -> DataFrame:
    """The pieces of all documents with the sequence each is in and its place there."""
    pieces = tokenized_pieces(docs, id_col, text_col, capacity, end_id, vocabulary, keep_ids)
    whole = F.col("length") == capacity
    alone = pieces.where(whole).withColumns(
        {"sequence_id": F.col("piece_uid"), "offset": F.lit(0).cast("bigint")}
    )
    rest = pieces.where(~whole)
    placed = pack_items(
        rest.select(F.col("piece_uid").alias("item"), F.col("length").alias("size")),
        capacity,
        slack,
        group,
        fan,
    )
    packed = rest.join(placed, F.col("piece_uid") == F.col("item")).drop("item")
    return alone.unionByName(packed).drop("piece_uid")
