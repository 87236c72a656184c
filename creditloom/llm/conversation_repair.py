"""Repair of damaged conversations: Viterbi over edits with coalescing survivors.

A conversation is right if the initials of its roles are ``(s?(ua)+)?``.  The edits Keep, Rerole,
Delete and Insert cost what ``Costs`` says; wanted is the cheapest audit (the edits' initials in
order), of equal ones the least string.  After each row there is one survivor for each state of the
grammar: nothing yet (E), behind ``s`` (S), behind ``u`` (U), behind ``a`` (A).

* Survivors stand in a backpointer tree whose segments hold runs of edits and count who refers to
  them.  A segment that lost all but one branch joins it; edits at the root that all survivors
  share are emitted and forgotten.  So only edits that are still open are in memory.
* Equal costs are settled by comparing the complete open suffixes from the last common
  segment on.  No survivor's audit begins another's (both end with the edit of the same row), so
  the order of two survivors never changes by what follows.
* A survivor is dropped once another one can take over any ending of it for less.  Without this
  "everything deleted" would survive for ever and nothing could coalesce.

Rows of one conversation may be a third of the table.  So the rows (without texts: initial, fault,
turn) are cut into sorted blocks by the whole sort key, and each block is run on its own: from
the empty state for conversations that begin in it, and from all four states for the first one
of the block, which may have begun before.  What a block makes of a state is a short table of
(state before, state behind, cost, audit); the blocks of a conversation are then put together by
the same survivor tree, whole audits of blocks being its steps.

Faults come from aggregates: rows that repeat role and text are found by the first turn of the
pair, so neither a conversation nor a much repeated text is gathered anywhere.  Only the digest
of repaired texts reads a conversation in one task, since SHA-256 has no other way; it keeps one
batch of rows.

Order and nulls: rows go by turn (nulls first), then role, then SHA-256 of the text, after damage.
Null roles and texts, and null ids and turns where they are written out, are one space.  Rows of a
null conv_id are one conversation.  A role that is empty or has another initial can be reroled or
deleted; kept it would break the grammar.  Texts are whole; other columns are not read.  An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, groupby, islice, zip_longest
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from creditloom.llm.common import arrow_rows, stage
from creditloom.session import shuffle_partitions

#: What can be done: (state behind, [(state before, cost, edits)]).
Moves = list[tuple[str, list[tuple[str, int, bytes]]]]

STATES = "ESUA"
#: What a row can be: content as it should be, cut off, or to be deleted.
WHOLE, CUT, GONE = 0, 1, 2


@dataclass(frozen=True)
class Costs:
    """Prices of edits; ``cut`` is added for a row that is cut off and stays.

    They must be such that reroling costs less than deleting, and inserting something.
    """

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    cut: int = 5

    def __post_init__(self):
        if not 0 <= self.keep <= self.rerole <= self.delete or self.insert < 1 or self.cut < 0:
            raise ValueError("needs 0 <= keep <= rerole <= delete, insert >= 1, cut >= 0")


def after(state: str, initial: str) -> str | None:
    """The state behind a row of this initial, if the grammar allows it there."""
    if initial == "s":
        return "S" if state == "E" else None
    if initial == "u":
        return "U" if state != "U" else None
    return "A" if initial == "a" and state == "U" else None


class Rules:
    """Steps of the Viterbi search for each kind of row."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self._steps: dict[tuple[str, int], list] = {}

    def inserted(self, state: str) -> Iterator[tuple[str, int, bytes]]:
        """States reached by insertions alone; a third one would only come back."""
        yield state, 0, b""
        for n in (1, 2):
            state = after(state, "a" if state == "U" else "u")
            yield state, n * self.costs.insert, b"I" * n

    def steps(self, initial: str, kind: int) -> Moves:
        if (initial, kind) not in self._steps:
            c, best = self.costs, {}
            extra = c.cut if kind == CUT else 0
            for before in STATES:
                for state, paid, edits in self.inserted(before):
                    found = [(state, c.delete, b"D")]
                    if kind != GONE:
                        kept = after(state, initial)
                        found += [(kept, c.keep + extra, b"K")] if kept else []
                        found.append((after(state, "a" if state == "U" else "u"), c.rerole + extra, b"R"))
                    for behind, price, edit in found:
                        key, value = (behind, before), (paid + price, edits + edit)
                        best[key] = min(best.get(key, value), value)
            self._steps[initial, kind] = [
                (behind, [(p, *best[behind, p]) for p in STATES if (behind, p) in best])
                for behind in STATES
                if any((behind, p) in best for p in STATES)
            ]
        return self._steps[initial, kind]

    @cached_property
    def endings(self) -> Moves:
        """The end of a conversation as a step: insertions up to a state that may be the last."""
        found = [
            (state, *min((paid, edits) for s, paid, edits in self.inserted(state) if s in "EA"))
            for state in STATES
        ]
        return [("A", found)]

    @cached_property
    def takeover(self) -> dict[tuple[str, str], int]:
        """(p, q): what q pays at most above p for the endings that p could have.

        It makes the edits of p's ending but for deleting a row where the grammar needs it, or
        inserting one; 0 means the very same edits.
        """
        d, n = self.costs.delete, self.costs.insert
        return {
            ("E", "S"): max(2 * n, d),
            ("E", "U"): max(n, 2 * d),
            ("E", "A"): d,
            ("S", "E"): 0,
            ("S", "U"): d,
            ("S", "A"): 0,
            ("U", "E"): d,
            ("U", "S"): n,
            ("U", "A"): d,
            ("A", "E"): 0,
            ("A", "S"): 2 * n,
            ("A", "U"): max(n, d),
        }


class Segment:
    """A run of edits in the backpointer tree; ``refs`` counts its branches and survivors."""

    __slots__ = ("parent", "edits", "refs")

    def __init__(self, parent: Segment | None, edits: bytes = b""):
        self.parent, self.edits, self.refs = parent, bytearray(edits), 1
        if parent is not None:
            parent.refs += 1


class Survivors:
    """The cheapest way into each state; ``settled`` holds the edits that all of them share."""

    def __init__(self, rules: Rules, start: str = "E"):
        self.rules = rules
        self.settled = bytearray()
        self.alive: dict[str, tuple[int, Segment]] = {start: (0, Segment(None))}

    def _path(self, leaf: Segment) -> list[Segment]:
        path = [leaf]
        while path[-1].parent is not None:
            path.append(path[-1].parent)
        return path[::-1]

    def _less(self, a: tuple[Segment, bytes], b: tuple[Segment, bytes]) -> bool:
        """Whether a's open edits and then its new ones come before b's, compared as strings."""
        x, y = self._path(a[0]), self._path(b[0])
        common = sum(p is q for p, q in zip(x, y))
        left, right = (
            chain(*(segment.edits for segment in path[common:]), new)
            for path, new in ((x, a[1]), (y, b[1]))
        )
        return next((p < q for p, q in zip_longest(left, right, fillvalue=-1) if p != q), False)

    def step(self, moves: Moves) -> None:
        """One row, or one block of rows: the best of the moves into each state."""
        chosen: dict[str, tuple[int, Segment, bytes]] = {}
        for behind, ways in moves:
            best = None
            for before, price, edits in ways:
                if before in self.alive:
                    paid, leaf = self.alive[before]
                    cost = paid + price
                    if best is None or cost < best[0] or (
                        cost == best[0] and self._less((leaf, edits), best[1:])
                    ):
                        best = (cost, leaf, edits)
            if best is not None:
                chosen[behind] = best
        self._drop_hopeless(chosen)
        grown = {s: (cost, Segment(leaf, edits)) for s, (cost, leaf, edits) in chosen.items()}
        for _, leaf in self.alive.values():
            self._release(leaf)
        self.alive = grown
        self._settle()

    def _drop_hopeless(self, chosen: dict[str, tuple[int, Segment, bytes]]) -> None:
        for state in [*chosen] if len(chosen) > 1 else []:
            cost, *way = chosen[state]
            for other, (paid, *their) in chosen.items():
                if other != state:
                    above = self.rules.takeover[state, other]
                    if paid + above < cost or (
                        not above and paid == cost and self._less(their, way)
                    ):
                        del chosen[state]
                        break

    def _release(self, segment: Segment | None) -> None:
        while segment is not None:
            segment.refs -= 1
            segment = segment.parent if not segment.refs else None

    def _settle(self) -> None:
        """Join segments of a single branch with it, and take the edits of the root."""
        for _, leaf in self.alive.values():
            below = leaf
            while (above := below.parent) is not None:
                if above.refs == 1:  # each edit moves up once for each of at most three levels
                    above.edits += below.edits
                    below.edits, below.parent = above.edits, above.parent
                else:
                    below = above
            if below.edits:
                self.settled += below.edits
                below.edits = bytearray()

    def table(self) -> list[tuple[str, int, bytes]]:
        """State, cost and whole audit of each survivor."""
        return [
            (state, cost, bytes(self.settled) + b"".join(bytes(s.edits) for s in self._path(leaf)))
            for state, (cost, leaf) in self.alive.items()
        ]


# ------------------------------------------------------------------------- rows of the table


def damaged_rows(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped (0),
    emptied (1), loses its ``.!?`` (2), stands twice (3) or becomes the user's (4).

    ``copies`` is how often a row stands there; dropped rows keep their conv_id.
    """
    space = F.lit(" ")
    written = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space),
        F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), space),
    )
    fault = F.crc32(written.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return conversations.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "")
        .when(fault == 2, F.translate(text, ".!?", ""))
        .otherwise(text)
        .alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _kind(text: Column) -> Column:
    last = F.right(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    return F.when(last == "", GONE).when(last.isin(".", "!", "?"), WHOLE).otherwise(CUT)


def _light_rows(rows: DataFrame) -> DataFrame:
    """One row per conversation, turn, role and text: its kind, how often it stands there, and
    whether role and text stood in an earlier turn.  Rows that are not there have 0 copies."""
    there = F.col("copies") > 0
    light = stage(
        rows.select(
            "conv_id",
            "turn",
            F.when(there, F.col("role")).alias("role"),
            F.when(there, _digest(F.col("text"))).alias("digest"),
            F.when(there, _kind(F.col("text"))).alias("kind"),
            "copies",
        )
        .groupBy("conv_id", "turn", "role", "digest", "kind")
        .agg(F.sum("copies").alias("copies")),
        "light-rows",
    )
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    again = (
        light.where(F.col("kind") != GONE)
        .groupBy("conv_id", "role", "digest")
        .agg(first.alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(
            F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("x"), "first"
        )
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
    seen = F.col("first").isNotNull()
    return light.join(again, same & (F.col("digest") == F.col("x")), "left").select(
        "conv_id",
        "turn",
        "role",
        "digest",
        "kind",
        "copies",
        (seen & ~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("seen"),
    )


# -------------------------------------------------------------------------- blocks of rows


class Block:
    """The rows of one conversation in one block."""

    def __init__(self, rules: Rules, may_continue: bool):
        self.rules = rules
        self.runs = {s: Survivors(rules, s) for s in (STATES if may_continue else "E")}
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, role: str, kind: int, copies: int, seen: bool) -> None:
        initial = role[:1]
        if self.first is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += copies - 1  # a row beside its like
        self.last = initial
        if turn is not None:  # rows come by turn
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if kind == GONE:
            self.blank += copies
        else:
            self.duplicate += copies - (not seen)
            self.truncated += not seen and kind == CUT
        for n in range(copies):
            moves = self.rules.steps(initial, GONE if n or seen else kind)
            for run in self.runs.values():
                run.step(moves)

    def summary(self) -> tuple:
        moves = [
            {"before": before, "behind": behind, "cost": cost, "audit": audit.decode()}
            for before, run in self.runs.items()
            for behind, cost, audit in run.table()
        ]
        return (
            self.blank, self.duplicate, self.truncated, self.illegal, self.turns,
            self.first, self.last, self.low, self.high, moves,
        )


_SUMMARY = (
    "block int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint,"
    " first string, last string, low bigint, high bigint,"
    " moves array<struct<before: string, behind: string, cost: bigint, audit: string>>"
)
_FOUND = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint,"
    " cost bigint, audit string"
)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    while part := [*islice(rows, size)]:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*part), schema)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _block_runner(costs: Costs, schema: pa.Schema):
    """Sorted rows of a partition -> one summary for each conversation in it."""

    def summaries(batches):
        rules, number = Rules(costs), TaskContext.get().partitionId()
        for n, (conv, rows) in enumerate(groupby(_rows(batches), key=itemgetter(0))):
            block = Block(rules, may_continue=n == 0)
            for _, turn, role, _, kind, copies, seen in rows:
                if copies:
                    block.add(turn, role, kind, copies, seen)
            yield (conv, number, *block.summary())

    return lambda batches: _batches(summaries(batches), schema)


def _joiner(costs: Costs, schema: pa.Schema):
    """Summaries by conversation and block -> faults, cost and audit of each conversation."""

    def joined(batches):
        rules = Rules(costs)
        for conv, blocks in groupby(_rows(batches), key=itemgetter(0)):
            run, last, low, high = Survivors(rules), None, None, None
            faults, turns = [0, 0, 0, 0], 0
            for block in blocks:
                faults = [x + y for x, y in zip(faults, block[2:6])]
                here, first, its_last, its_low, its_high, moves = block[6:]
                if first is not None:
                    faults[3] += last is not None and last + first not in ("su", "ua", "au")
                    last = its_last
                if its_low is not None:
                    turns += here - (its_low == high)
                    low, high = its_low if low is None else low, its_high
                into: dict[str, list] = {}
                for m in moves:
                    into.setdefault(m["behind"], []).append(
                        (m["before"], m["cost"], m["audit"].encode())
                    )
                run.step([*into.items()])
            run.step(rules.endings)
            ((_, cost, audit),) = run.table()
            gaps = 0 if low is None else high - low + 1 - turns
            yield (conv, gaps, *faults, cost, audit.decode())

    return lambda batches: _batches(joined(batches), schema)


def find_repairs(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost and audit.

    ``rows`` has conv_id, turn, role, text and copies.  A conversation without rows has zeros and
    an empty audit.
    """
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    light = _light_rows(rows)
    order = ["conv_id", "turn", "role", "digest"]
    blocks = light.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    schemas = [f"conv_id {kind}, {rest}" for rest in (_SUMMARY, _FOUND)]
    summary, found = (to_arrow_schema(StructType.fromDDL(x)) for x in schemas)
    summaries = stage(blocks.mapInArrow(_block_runner(costs, summary), schemas[0]), "blocks")
    together = summaries.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return together.mapInArrow(_joiner(costs, found), schemas[1])


# ------------------------------------------------------------------------------ repaired rows


def replay(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of each edit of ``audit`` over the rows (role, text) in order."""
    rows, state = iter(rows), "E"
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit in "IR":
            role = "assistant" if state == "U" else "user"
        if edit != "D":
            state = after(state, role[:1])
        yield edit, role, text


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Conversation and its edits; the audit comes first, its rows behind it."""
    for conv, rows in groupby(_rows(batches), key=itemgetter(0)):
        head = next(rows)
        texts = ((role, text) for *_, role, _, text, copies, _ in rows for _ in range(copies))
        yield conv, replay(head[-1], texts)


def _repairer(schema: pa.Schema):
    def repaired(batches):
        for conv, edits in _stream(batches):
            for place, (edit, role, text) in enumerate(edits):
                yield conv, place, edit, role, text

    return lambda batches: _batches(repaired(batches), schema, 256)


def _hasher(schema: pa.Schema):
    def hashed(batches):
        for conv, edits in _stream(batches):
            digest, between = hashlib.sha256(), ""
            for edit, role, text in edits:
                if edit != "D":
                    digest.update(f"{between}{role}:{text}".encode())
                    between = "\n"
            yield conv, digest.hexdigest()

    return lambda batches: _batches(hashed(batches), schema)


def _audited(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows, sorted; texts are shuffled once."""
    arrow_rows(rows.sparkSession)
    texts = rows.where("copies > 0").select(
        "conv_id",
        F.lit(1).alias("part"),
        "turn",
        "role",
        _digest(F.col("text")).alias("digest"),
        "text",
        "copies",
        F.lit(None).cast("string").alias("audit"),
    )
    audits = found.select("conv_id", F.lit(0).alias("part"), "audit")
    order = ["conv_id", "part", "turn", "role", "digest"]
    both = texts.unionByName(audits, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(*order)


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place (of the edit, from 0), edit, role and text; deleted rows with their own."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, place bigint, edit string, role string, text string"
    fn = _repairer(to_arrow_schema(StructType.fromDDL(schema)))
    return _audited(rows, found).mapInArrow(fn, schema)


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its repaired ``role:text`` lines."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, repaired_sha256 string"
    fn = _hasher(to_arrow_schema(StructType.fromDDL(schema)))
    return _audited(rows, found).mapInArrow(fn, schema)


def repair(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Damage the conversations, find the cheapest repair of each, and digest its result."""
    rows = damaged_rows(conversations)
    found = stage(find_repairs(rows, costs), "repairs")
    digests = repaired_digests(rows, found).select(F.col("conv_id").alias("_c"), "repaired_sha256")
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    return found.join(digests, same).drop("_c")
